"""Operator 7: exact duplicates by an extendible-hash index on shared files.

A text is keyed by the 64-bit hash of its normalised form (white space deleted). Directory: the rows under each value
of the hash's first ``DEPTH`` bits are counted; starting from one bucket for all, a bucket with more rows than it may
hold is split by the next bit, which doubles the directory wherever that is needed. A bucket that is overfull at full
depth has a hot key; it gets overflow pages instead, and its rows are dealt over them.

Index: one entry per distinct normalised text, stored as Parquet in the shared folder with its bucket. Building it
compares bytes: rows with one hash are chained in one group only if their normalised texts are equal byte for byte
(the text itself is a grouping key, and copies are combined before the shuffle). Lookup: each row goes to its
bucket's owner (and page) and finds its entry by hash and text digest. The directory has at most ``2 ** DEPTH``
cells, whatever the input, so it is the only thing broadcast.

Edge cases: a null text is empty; texts of white space alone equal the empty text; rows that share a doc_id are rows
of their own, and of identical rows (same doc_id and text) each is reported, all kept or all dropped alike; a null
doc_id comes last among equals; an empty table gives no row. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, only, query, row_key, table, written

DEPTH = 14
#: A bucket may hold so many times the rows that an even directory of full depth would give it, and this many at least.
SLACK, LEAST = 4, 1_000
WHITE = " \t\n\u000b\f\r"

SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER best AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW best AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
"""


def normalised(text: Column) -> Column:
    """``text`` without the six white-space characters of ASCII."""
    for character in WHITE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def directory(rows: DataFrame, depth: int = DEPTH, slack: int = SLACK, least: int = LEAST) -> DataFrame:
    """``_cell`` (first ``depth`` bits of ``_hash``), ``_bucket`` (local depth and prefix in one number), ``_pages``.

    Every cell that has rows appears: at most ``2 ** depth``.
    """
    cells = rows.groupBy(_cell(F.col("_hash"), depth).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    room = F.lit(max(least, -(-rows.count() * slack // (1 << depth))))
    sums = cells.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_depth"), "_cell", "_n").groupBy(
        "_depth", F.expr(f"shiftright(_cell, {depth} - _depth)").alias("_prefix")
    ).agg(F.sum("_n").alias("_rows"))
    # a prefix is split while it is overfull; a bucket is the first prefix on a cell's way that is not, or full depth
    spread = cells.select("_cell", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_depth")).withColumn(
        "_prefix", F.expr(f"shiftright(_cell, {depth} - _depth)")
    )
    ends = spread.join(sums, ["_depth", "_prefix"]).where((F.col("_rows") <= room) | (F.col("_depth") == depth))
    return ends.groupBy("_cell").agg(
        F.min(F.struct("_depth", "_prefix", F.ceil(F.col("_rows") / room).cast("int").alias("_pages"))).alias("_end")
    ).select(
        "_cell",
        (F.col("_end._depth").cast("long") * (1 << 32) + F.col("_end._prefix")).alias("_bucket"),
        F.greatest(F.lit(1), F.col("_end._pages")).alias("_pages"),
    )


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


def _cell(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth).cast("int")


def exact_duplicates(docs: DataFrame, depth: int = DEPTH, slack: int = SLACK, least: int = LEAST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    return _verdicts(docs, depth, slack, least).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all columns: the longest, then of the smallest doc_id."""
    kept = _verdicts(docs, DEPTH, SLACK, LEAST).where("kept").groupBy("text_sha256").agg(F.max(F.struct("_size", "_row_key")).alias("_one"))
    return only(docs, kept.select("_one._row_key"))


def _verdicts(docs: DataFrame, depth: int, slack: int, least: int) -> DataFrame:
    rows = documents(docs)
    text = rows.select(
        "doc_id", F.length("text").alias("_size"), normalised(F.col("text")).alias("_norm"), row_key(rows).alias("_row_key")
    )
    keyed = text.withColumn("_hash", F.xxhash64("_norm"))
    rows = written(keyed.select("doc_id", "_size", "_row_key", "_hash", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_digest")), "dedup-rows")
    cells = written(directory(rows, depth, slack, least), "dedup-directory")
    # longest original text, then smallest doc_id, as one fixed-width number of which the largest wins: the size
    # above, 2 ** 63 - doc_id below (1 to 2 ** 64), 0 below for a null id
    low = F.coalesce(_whole(1 << 63) - F.col("doc_id").cast("decimal(20,0)"), _whole(0))
    rank = (F.col("_size").cast("decimal(10,0)") * _whole(1 << 65) + low).cast("decimal(38,0)")
    chained = keyed.groupBy("_hash", "_norm").agg(F.max(rank).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    low = F.col("_best") % _whole(1 << 65)
    entries = chained.select(
        "_hash", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_digest"), "group_size",
        F.when(low > 0, _whole(1 << 63) - low).cast("long").alias("keep_id"),
    )
    index = written(_addressed(entries, cells, depth), "dedup-index")
    pages = index.withColumn("_page", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1))).drop("_pages")
    routed = _addressed(rows, cells, depth).withColumn(
        "_page", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_pages")).cast("int")
    ).drop("_pages")
    return routed.join(pages, ["_bucket", "_page", "_hash", "_digest"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"), "_size", "_row_key",
    )


def _addressed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket and the pages that the directory has for their hash."""
    return rows.withColumn("_cell", _cell(F.col("_hash"), depth)).join(F.broadcast(cells), "_cell").drop("_cell")


@query("op7_exact_dedup", SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
