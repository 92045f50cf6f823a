"""Writers, keyed tables with last-wins reads, and result storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import results_metadata
from ..operators.layout import last_per_key
from ..schemas import INSTANCE_COLUMNS


def write_instances(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The instance columns in their fixed order."""
    df.select(*INSTANCE_COLUMNS).write.mode("overwrite").format(fmt).save(path)


def write_published_split(df: DataFrame, path: str, split: str = "test") -> None:
    df.write.mode("overwrite").parquet(f"{path}/split={split}")


def write_final_results(features: DataFrame, path: str) -> None:
    """Enhanced features as a distributed table, and one row of counts of that table beside it."""
    features.write.mode("overwrite").json(f"{path}/results")
    stored = features.sparkSession.read.schema(features.schema).json(f"{path}/results")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    counts = results_metadata(stored).withColumn("generated_at", stamp)
    counts.write.mode("overwrite").json(f"{path}/metadata")


def upsert_keyed_cache(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str | None = None
) -> DataFrame:
    """Rows of both, where an update replaces the row of its key and the last update wins.

    Without ``order_col`` the updates have one row per key.
    """
    order = F.struct(F.lit(1), F.col(order_col)) if order_col else F.struct(F.lit(1), F.lit(0))
    base = F.struct(F.lit(0), F.col(order_col)) if order_col else F.struct(F.lit(0), F.lit(0))
    both = current.withColumn("_order", base).unionByName(updates.withColumn("_order", order))
    return last_per_key(both, list(keys), ["_order"]).drop("_order")


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch of a keyed table; writing the same batch again replaces it.

    Batches are separate folders, so an update costs its own size, not that of the table. They are whole numbers:
    as text, 10 would come before 9.
    """
    if isinstance(batch, bool) or not isinstance(batch, int) or batch < 0:
        raise ValueError(f"a batch is a whole number, not {batch!r}")
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_keyed(
    spark: SparkSession, path: str, keys: Sequence[str], order_col: str | None = None
) -> DataFrame:
    """Current rows of a keyed table: the last row of every key over all batches."""
    df = spark.read.option("basePath", path).parquet(path)
    order = ["batch", order_col] if order_col else ["batch"]
    return last_per_key(df, list(keys), order).drop("batch")


def compact_keyed(
    spark: SparkSession, path: str, target: str, keys: Sequence[str], order_col: str | None = None
) -> None:
    """Write the current rows as batch 0 of a new folder; readers switch when it is complete."""
    append_batch(read_keyed(spark, path, keys, order_col), target, 0)


def save_results(df: DataFrame, path: str, run_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def load_results(
    spark: SparkSession, path: str, schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stored results and their distinct (agent, instance_id) keys; nothing stored is empty."""
    try:
        results = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        results = spark.createDataFrame([], schema or "agent string, instance_id string")
    return results, results.select("agent", "instance_id").distinct()


def store_test_logs(df: DataFrame, path: str, batch: int = 0) -> None:
    """Logs keyed by (instance_id, phase); read back with :func:`read_keyed`."""
    append_batch(df.select("instance_id", "phase", "log"), path, batch)
