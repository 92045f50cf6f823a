"""Operator 4: document fingerprints of closed syncmers.

A text is a sequence of words, a k-mer ``WORDS`` words that stand side by side. Every word has a hash; a k-mer is
chosen if the smallest hash of its words stands at its first or last place. The choice looks at nothing outside the
k-mer, so a passage has the same anchors wherever it stands. The fingerprint lists the 32-bit hashes of the chosen
k-mers in text order. Likeness of two fingerprints is the share of anchors they have in common:
``2 |A & B| / (|A| + |B|)`` over distinct anchors.

Everything is a column expression; texts are shuffled once, by doc_id, to meet the next document.

Edge cases: a null text is empty; a text without words has the empty fingerprint, two of these are alike (1), one is
not like any other (0); fewer words than a k-mer are one k-mer; of a text without a chosen k-mer (5 to 7 words only)
all k-mers are anchors; a null doc_id orders behind all others; rows that
share a doc_id each get a result, and the next document is then the one of the next smaller doc_id (of several rows
with that id the one with the smallest text hash); a table of one doc_id is its own next document; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import documents, query, table, written

WORDS = 5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def anchors(text: Column, words: int = WORDS) -> Column:
    """Array of (pos: number of the k-mer's first word from 1, anchor: its 32-bit hash), in text order."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def chosen(hashes: Column) -> Column:
        size = F.size(hashes)
        ends = lambda i: F.least(F.get(hashes, i - 1), F.get(hashes, i + (words - 2)))
        edge = lambda i: (size < words) | (F.array_min(F.slice(hashes, i, words)) == ends(i))
        every = F.sequence(F.lit(1), F.greatest(F.lit(1), size - (words - 1)))
        starts = _let(F.filter(every, edge), lambda some: F.when(F.size(some) > 0, some).otherwise(every))
        anchor = lambda i: F.struct(i.alias("pos"), F.shiftright(F.xxhash64(F.slice(hashes, i, words)), 32).cast("int").alias("anchor"))
        none = F.expr("array()").cast("array<struct<pos: int, anchor: int>>")
        return F.when(size > 0, F.transform(starts, anchor)).otherwise(none)

    return _let(F.transform(found, lambda w: F.xxhash64(w)), chosen)


def fingerprint(marks: Column) -> Column:
    """Anchors (an array of ints in text order) as text: eight hex digits each."""
    return F.lower(F.array_join(F.transform(marks, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), " "))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of anchors, 0 to 1."""
    both, total = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def successors(keys: DataFrame) -> DataFrame:
    """Each key (``_null``, ``_id``; distinct) with the next one in descending order (``_next_null``, ``_next_id``).

    Keys are dealt by ranges; within a range the next is a window, and the last of a range takes the first of the
    next range. Only one row per range meets in one task.
    """
    order = [F.asc("_null"), F.desc("_id")]
    ranged = written(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("_range").orderBy(*order)
    key = F.struct("_null", "_id")
    near = ranged.withColumns({"_lead": F.lead(key).over(inside), "_place": F.row_number().over(inside)})
    heads = near.where("_place = 1").select(F.col("_range").alias("_at"), key.alias("_head"))
    along = Window.partitionBy(F.lit(0)).orderBy("_at")  # one row per range
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(F.col("_at").alias("_range"), F.coalesce(F.lead("_head").over(along), F.first("_head").over(whole)).alias("_head"))
    joined = near.join(F.broadcast(after), "_range").withColumn("_next", F.coalesce("_lead", "_head"))
    return joined.select(*keys.columns, F.col("_next._null").alias("_next_null"), F.col("_next._id").alias("_next_id"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document."""
    rows = documents(docs).select(F.col("doc_id").isNull().cast("int").alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "text")
    third = F.floor(F.length("text") / 3).cast("int")
    keys = rows.groupBy("_null", "_id").agg(
        F.max(third).alias("_need"), F.min(F.xxhash64("text")).alias("_mark"), F.count(F.lit(1)).alias("_rows")
    )
    order = written(successors(keys), "fingerprint-next")
    needs = order.select(
        F.col("_next_null").alias("_null"), F.col("_next_id").alias("_id"), "_need",
        F.col("_null").alias("_for_null"), F.col("_id").alias("_for_id"),
    )
    source = rows
    if order.where("_rows > 1").limit(1).count():  # a doc_id of several rows gives the text of one
        source = rows.join(order.select("_null", "_id", "_mark"), ["_null", "_id"]).where(F.xxhash64("text") == F.col("_mark"))
        source = source.select("_null", "_id", "text").dropDuplicates(["_null", "_id"])
    # rows and source have the same columns and share the shuffle by id; starts and anchors then go to the row before
    given = source.join(needs, ["_null", "_id"]).select(
        F.col("_for_null").alias("_null"), F.col("_for_id").alias("_id"),
        F.expr("left(text, _need)").alias("_start"), anchors(F.col("text"), words)["anchor"].alias("_next"),
    )
    edited = F.concat(F.expr("left(text, length(text) - _third)"), F.expr("left(_start, _third)"))
    met = rows.join(given, ["_null", "_id"]).withColumn("_third", third).select(
        F.when(F.col("_null") == 0, F.col("_id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "_next",
        anchors(F.col("text"), words)["anchor"].alias("_own"), edited.alias("_edited"),
    )
    marked = met.select(
        "doc_id", "n_chars", "_next", "_own", anchors(F.col("_edited"), words)["anchor"].alias("_changed"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprint(F.col("_changed")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
