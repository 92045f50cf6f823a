"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import last_per_key
from ..sources.keyed import BUCKETS, next_batch, upsert_buckets
from ..sources.tables import append_batch


def stream_upsert_keyed(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_col: str
) -> StreamingQuery:
    """Keep a keyed table up to date; read it with ``read_keyed``.

    Every micro-batch lands in its own folder, numbered on from the batches that the table had when this stream
    began; that number is kept beside the checkpoint. So a batch that is repeated after a failure replaces itself,
    and a stream with a new checkpoint never replaces a batch of another writer.
    """
    first = _first_batch(stream.sparkSession, path, checkpoint)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        append_batch(last_per_key(batch, list(keys), [order_col]), path, first + batch_id)

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert_buckets(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_col: str | None = None, by_batch: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep a keyed table in hash buckets up to date; read it with ``read_buckets``.

    A micro-batch rewrites the buckets it touches. Batches are numbered on from those the table had when this stream
    began, so one that is repeated after a failure changes nothing.
    """
    first = _first_number(stream.sparkSession, checkpoint, lambda: next_batch(stream.sparkSession, path))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_buckets(batch, path, keys, order_col, first + batch_id, by_batch, buckets)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_eval_results(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last result of every (agent, instance_id) by ``finished_at``: a second one replaces the first.

    ``judging`` counts over ``read_buckets`` of it then agree with those over all results at once.
    """
    rows = stream.select("agent", "instance_id", "finished_at", "success")
    return stream_upsert_buckets(rows, path, checkpoint, ["agent", "instance_id"], "finished_at", by_batch=False, buckets=buckets)


def progress_of(results: DataFrame) -> DataFrame:
    """Finished and successful pairs per agent, over one row per (agent, instance_id)."""
    return results.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("resolved"))


def _stored(read: Callable[[], DataFrame]) -> int | None:
    """The number in a table of one row and column; None where there is no such table yet."""
    try:
        return read().first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _first_number(spark: SparkSession, checkpoint: str, number: Callable[[], int]) -> int:
    """``number`` as it was when a stream with this checkpoint first began."""
    kept = f"{checkpoint.rstrip('/')}-first-batch"
    first = _stored(lambda: spark.read.schema("first long").json(kept))
    if first is None:
        first = number()
        spark.range(1).select(F.lit(first).alias("first")).write.json(kept)
    return first


def _first_batch(spark: SparkSession, path: str, checkpoint: str) -> int:
    def following() -> int:
        last = _stored(lambda: spark.read.option("basePath", path).parquet(path).agg(F.max("batch")))
        return 0 if last is None else last + 1

    return _first_number(spark, checkpoint, following)


def stream_new_releases(stream: DataFrame, valid: Column, keep: str = "30 days") -> DataFrame:
    """Valid releases, each (repo, tag_name) once, however late its first arrival is.

    The watermark runs over the time of arrival, not of publishing, so no row is ever late. The state of a key is its
    expiry: ``keep`` after its first arrival the mark that it was seen goes, so the state does not grow for ever.
    """
    return (
        stream.where(valid)
        .withColumn("published", F.try_to_timestamp("published_at"))
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", keep)
        .dropDuplicatesWithinWatermark(["repo", "tag_name"])
    )


def stream_eval_progress(
    stream: DataFrame, width: str = "10 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Finished and successful runs per agent and time window, once a window is complete."""
    counts = (
        stream.withWatermark("finished_at", delay)
        .groupBy(F.window("finished_at", width), "agent")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("resolved"))
    )
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "agent", "n", "resolved",
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to a Parquet folder until the input at hand is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
