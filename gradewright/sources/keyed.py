"""Keyed tables in hash buckets: an update rewrites the buckets that its keys fall into, and no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import last_per_key, stored

BUCKETS = 256
PART_ROWS = 500_000  # of a bucket that a task sorts
COUNT, BUCKET, BATCH = "buckets", "bucket", "batch"  # folders of the table, and the update that a row came with


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in keys]), F.lit(buckets)).cast("int")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert_buckets(
    updates: DataFrame, path: str, keys: Sequence[str], order_col: str | None = None, batch: int = 0, by_batch: bool = True,
    buckets: int = BUCKETS, unique: bool = False, by: Sequence[str] | None = None, part_rows: int = PART_ROWS,
) -> None:
    """Merge ``updates`` into the keyed table at ``path``; the last row of a key stays.

    The last is that of the highest ``batch``, inside a batch of the highest ``order_col``; with ``by_batch=False`` that
    of the highest ``order_col`` whenever it came. Both make a repeated update harmless, also an old one after a newer
    one. Updates are cut to a row per key first, so a hot key sends one row per task. Only buckets that they touch are
    read (by folder) and written, by dynamic partition overwrite: the rest of the table is not moved. ``buckets`` and
    ``by``, the keys that choose a bucket (all by default), belong to the table and cannot change. ``unique`` says that
    updates have a row per key already. An update is stored once, in the order of its keys: finding its buckets and
    merging it do not both compute it, and rows that are alike are moved and kept side by side, which packs them. A
    bucket of more than ``part_rows`` rows is merged in parts, so no task sorts a large one.
    """
    keys, spark = list(keys), updates.sparkSession
    by = keys if by is None else list(by)
    order = [c for c in ([BATCH] if by_batch else []) + ([order_col] if order_col else [])] or [BATCH]
    new = updates.withColumn(BATCH, F.lit(batch).cast("long"))
    new = (new if unique else last_per_key(new, keys, order)).withColumn(BUCKET, _bucket(by, buckets))
    current = _existing(spark, path)
    if current is not None:
        known = current.select(COUNT, (F.col(BUCKET) == _bucket(by, buckets)).alias("_placed"))
        counts = [r[0] for r in known.select(COUNT).distinct().limit(2).collect()]
        if counts and counts != [buckets]:
            raise ValueError(f"{path} has {counts[0]} buckets, not {buckets}")
        if not all(r["_placed"] for r in known.limit(100).collect()):
            raise ValueError(f"the buckets of {path} are not chosen by {', '.join(by)}")
    new = stored(new.sortWithinPartitions(*by, *[c for c in keys if c not in by]), "update")
    if current is not None:
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        new = new.unionByName(current.where(F.col(BUCKET).isin(touched)).drop(COUNT))
    most = {r[0]: -(-r[1] // part_rows) for r in new.groupBy(BUCKET).count().collect()}  # parts of each bucket
    if sum(most.values()) == len(most):
        merged, dealt = new.repartition(BUCKET), [BUCKET]
    else:
        parts = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
        part = F.pmod(F.hash(*[F.col(c).cast("string") for c in by]).cast("long"), F.element_at(parts, F.col(BUCKET)))  # another hash than the buckets'
        tasks = max(2 * sum(most.values()), spark.sparkContext.defaultParallelism)
        merged, dealt = new.withColumn("_part", part.cast("int")).repartition(tasks, BUCKET, "_part"), [BUCKET, "_part"]
    # both sides have a row per key, so parts are even; the window needs no further shuffle
    if current is not None:
        merged = last_per_key(merged, [*dealt, *keys], order)
    merged = merged.drop("_part").withColumn(COUNT, F.lit(buckets))
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(COUNT, BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a keyed table, one per key."""
    return spark.read.option("basePath", path).parquet(path).drop(COUNT, BUCKET, BATCH)


def next_batch(spark: SparkSession, path: str) -> int:
    """A number above those of all updates whose rows are in the table."""
    current = _existing(spark, path)
    last = None if current is None else current.agg(F.max(BATCH)).first()[0]
    return 0 if last is None else last + 1
