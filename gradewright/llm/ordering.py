"""Global places of rows by range partitions and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import written

#: ``monotonically_increasing_id`` has the row's place in its partition in these bits, the partition above.
PLACE_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``_range`` and ``_rank`` (0-based place in ``order``, which must tell all rows apart).

    Rows are dealt by ranges of the order and stored as they lie in their range; the ranges' sizes, one row each, are
    summed up. No task holds more than a range, whatever key is hot.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("_range", F.shiftright("_at", PLACE_BITS).cast("int"))
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_size")  # one row per range
    bases = sizes.select("_range", before.alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return laid.join(F.broadcast(bases), "_range").withColumn("_rank", place).drop("_at", "_base")
