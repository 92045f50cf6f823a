"""Operator 10: SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes, so a linked pair shares at least 5
positional bytes, and at least 3 of them lie in the first four positions or in the last four. The index therefore
has a posting list for each of the eight triples of positions inside one half and each value of its three bytes:
every pair that can reach 5 shared bytes meets in a list, most others never do. Pairs of a list are tallied (shared
positional bytes), those with 5 or more are kept, and these are verified by their differing bits.

Equal fingerprints are one class before the index is built. A list with more than ``dense`` classes is not paired:
its classes go another exact way. A class names all values within 2 bits of its own, as *near* those within 1 bit;
two fingerprints are linked exactly if one is near a value that the other names, and whoever names a value that a
class is near to is linked to that class. So each value gives a star around its smallest near class: linear in the
classes, no pairs, and the same components.

Components come from label propagation with pointer jumping over the links between classes. Documents join their
class at the end.

Edge cases: a null or empty text, or one of white space, has fingerprint 0 and links like any other; fewer words
than a shingle make one shingle; rows that share a doc_id each keep their row; a null doc_id is never the smallest
(a component of null ids alone has the id null); an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .registry import documents, only, query, row_key, table, written

WORDS = 3
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
DENSE = 512
SHINGLES_AT_ONCE = 1 << 17
#: Triples of byte positions within one half.
LISTS = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _set_bits(hashes: list[int]) -> np.ndarray:
    """One row of 64 zeros and ones for each hash, the highest bit first."""
    return np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1)


def fingerprint(text: bytes, words: int = WORDS, at_once: int = SHINGLES_AT_ONCE) -> int:
    """SimHash of one text in UTF-8, unsigned."""
    import xxhash

    found = text.lower().split()  # of bytes: only A-Z change, and only ASCII white space cuts
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) for w in found]) + np.arange(len(found))
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[words - 1 :].tolist() if len(found) >= words else [len(line)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(last), at_once):
        pairs = zip(starts[k : k + at_once], last[k : k + at_once])
        counts += _set_bits([digest(line[a:b], 42) for a, b in pairs]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, ``_fp`` (the fingerprint as a signed long) and ``_row_key``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), words) for t in texts], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], names=["doc_id", "_fp", "_row_key"])

    rows = documents(docs)
    return rows.withColumn("_row_key", row_key(rows)).mapInArrow(hashed, "doc_id long, _fp long, _row_key binary")


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(0xFF)


def _lists(fp: Column) -> Column:
    """The posting lists of a fingerprint: list number above, three bytes below."""
    def name(k: int, positions: tuple[int, ...]) -> Column:
        value = F.lit(k).cast("long") * (1 << 24)
        for place, position in enumerate(positions):
            value = value + _byte(fp, position) * (1 << (8 * place))
        return value

    return F.array(*[name(k, t) for k, t in enumerate(LISTS)])


def shared_bytes(a: Column, b: Column) -> Column:
    """How many byte positions agree."""
    differing = a.bitwiseXOR(b)
    return sum((_byte(differing, p) == 0).cast("int") for p in range(8))


def _first_list(a: Column, b: Column) -> Column:
    """The number of the first posting list that holds both, so that each pair is taken once."""
    differing = a.bitwiseXOR(b)
    chosen = F.lit(len(LISTS))
    for k, positions in reversed(list(enumerate(LISTS))):
        mask = sum(0xFF << (8 * p) for p in positions)
        mask -= (mask >> 63) << 64
        chosen = F.when(differing.bitwiseAND(F.lit(mask)) == 0, k).otherwise(chosen)
    return chosen


def _around(most: int) -> list[int]:
    """All masks of up to ``most`` of 64 bits, as signed longs, fewest bits first."""
    masks = [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(64), n)]
    return [m - ((m >> 63) << 64) for m in masks]


def links(classes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (``_fp``) whose components are those of all linked pairs."""
    postings = classes.select("_fp", F.explode(_lists(F.col("_fp"))).alias("_list"))
    sizes = postings.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = written(postings.join(sizes, "_list"), "simhash-postings")
    few = sized.where(F.col("_n") <= dense)
    one, two = few.select("_list", F.col("_fp").alias("a")), few.select("_list", F.col("_fp").alias("b"))
    met = one.join(two, "_list").where("a < b")
    tallied = met.where(shared_bytes(F.col("a"), F.col("b")) >= LEAST_BYTES)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    by_pairs = verified.where(F.shiftrightunsigned("_list", 24) <= _first_list(F.col("a"), F.col("b"))).select("a", "b")

    # the masks are a literal of 2,081 numbers, the first 65 of them near
    near, named = _around(MOST_BITS // 2), _around(MOST_BITS - MOST_BITS // 2)
    many = sized.where(F.col("_n") > dense).select("_fp").distinct()
    values = many.select("_fp", F.posexplode(F.array(*[F.lit(m) for m in named])).alias("_at", "_mask")).select(
        F.col("_fp").alias("b"), F.col("_fp").bitwiseXOR(F.col("_mask")).alias("_value"), (F.col("_at") < len(near)).alias("_near")
    )
    hubs = values.groupBy("_value").agg(
        F.min(F.when(F.col("_near"), F.col("b"))).alias("a"), F.count(F.lit(1)).alias("_n")
    ).where("a is not null and _n > 1").select("_value", "a")
    by_stars = values.join(hubs, "_value").where("a <> b").select("a", "b").distinct()
    return by_pairs.union(by_stars)


def _grouped(docs: DataFrame, words: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and the component of each distinct one with its smallest doc_id."""
    hashed = written(fingerprints(docs, words), "simhash")
    classes = written(hashed.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "simhash-classes")
    found = components(links(classes.select("_fp"), dense))
    labelled = classes.join(found, classes["_fp"] == found["node"], "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_component")
    )
    least = labelled.groupBy("_component").agg(F.min("_least").alias("component_id"))
    return hashed, labelled.join(least, "_component").select("_fp", "_component", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    hashed, ids = _grouped(docs, words, dense)
    return hashed.join(ids, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, words: int = WORDS, dense: int = DENSE) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: that of the smallest doc_id."""
    hashed, ids = _grouped(docs, words, dense)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key")).alias("_one")
    kept = hashed.join(ids, "_fp").groupBy("_component").agg(best)
    return only(docs, kept.select("_one._row_key"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
