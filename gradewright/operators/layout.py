"""Helpers that keep one hot key from ending up in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

HEAVY_ROWS = 1_000_000
BUCKETS = 65_536
SALTS = 64


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()
            and "variant" not in f.dataType.simpleString()]


def _bucket(on: Sequence[str]) -> Column:
    """Hash bucket of a key; text and whole numbers of different widths hash alike on both sides of a join."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in on]), F.lit(BUCKETS)).cast("int").alias("_bucket")


def heavy_keys(
    df: DataFrame, on: Sequence[str], heavy_rows: int = HEAVY_ROWS, rows: Column | None = None
) -> DataFrame:
    """Hash buckets of keys with more than ``heavy_rows`` rows and far more than the mean, with ``_excess``.

    Counting buckets instead of keys bounds the result by ``BUCKETS`` rows whatever the input, and misses no hot key.
    ``_excess`` says how many times over the bucket is. ``rows`` sums a column of counts for input that is counted already.
    """
    # counted by a condition, as a filter would move into the input and keep Spark from sharing its shuffle
    total = F.sum(F.when(_all_present(on), F.lit(1) if rows is None else rows).otherwise(F.lit(0)))
    counts = df.groupBy(_bucket(on)).agg(total.alias("_rows"))
    whole = F.sum("_rows").over(Window.partitionBy(F.lit(0)))  # over at most BUCKETS rows
    limit = F.greatest(F.lit(heavy_rows), 8 * whole / BUCKETS)
    excess = F.ceil(F.col("_rows") / limit).cast("int")
    # above the window, where it cannot move into the input and keep Spark from sharing its shuffle
    return counts.withColumn("_excess", excess).where("_excess > 1").select("_bucket", "_excess")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    heavy: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    salts: int = SALTS,
    sorted_merge: bool = False,
) -> DataFrame:
    """Equi-join of many rows (left) to at most one row per key (right), safe for hot keys.

    Buckets of keys with too many rows on the left are found by a counting aggregate, or given as ``heavy`` where a
    cheaper table than the left side tells them. Their left rows are spread over ``salts`` sub-keys at most and their
    right rows are copied to each, so no task holds a whole hot key; all other keys join as they are. A row's sub-key
    comes from a hash of all its columns (maps and variants aside), so a task that runs again after an executor was
    lost deals its rows as before, in whatever order they come; rows equal in all columns go together. The list of
    buckets is broadcast: it has at most ``BUCKETS`` rows. Null keys match nothing and are spread too. ``sorted_merge``
    keeps Spark from broadcasting a side: for sides that are exploded, whose rows Spark's estimate does not count.
    """
    on = list(on)
    if heavy is None:
        heavy = heavy_keys(left, on, heavy_rows)
    many = F.least(F.lit(salts), 2 * F.col("_excess"))
    spread_over = F.when(F.col("_excess").isNotNull(), many).when(~_all_present(on), F.lit(salts))
    content = F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(left)])
    dealt = F.when(spread_over.isNotNull(), F.pmod(content, spread_over)).cast("int")  # hashed for rows to be spread alone
    left_salted = (
        left.withColumn("_bucket", _bucket(on)).join(F.broadcast(heavy), "_bucket", "left")
        .withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_excess", "_bucket")
    )
    copies = F.when(F.col("_excess").isNotNull(), F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.lit(0)))
    right_salted = (
        right.withColumn("_bucket", _bucket(on)).join(F.broadcast(heavy), "_bucket", "left")
        .withColumn("_salt", F.explode(copies)).drop("_excess", "_bucket")
    )
    if sorted_merge:
        right_salted = right_salted.hint("merge")
    return left_salted.join(right_salted, [*on, "_salt"], how).drop("_salt")


def _all_present(columns: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    return present


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, cut finer before row-wise work that outweighs a shuffle.

    Inputs with enough splits stay as they are. For scans only: counting the partitions of a plan
    with shuffles would run them.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


DEALT_ROWS = 250_000


def dealing(df: DataFrame, on: Sequence[str], rows: int = DEALT_ROWS, heavy_rows: int = HEAVY_ROWS) -> tuple[int | str, ...]:
    """What ``repartition`` deals ``df`` by ``on`` with to tasks of about ``rows`` rows; the same deals other tables alike.

    Where a bucket of keys (or of nulls) is too large for a task, it names no column, so rows are dealt evenly.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(_bucket(on)).agg(F.count(F.lit(1)).alias("_rows"))  # at most BUCKETS rows
    total, most = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    tasks = max(wanted, -(-total // rows))
    return (tasks,) if most > max(heavy_rows, 8 * total // BUCKETS) else (tasks, *on)


def dealt(df: DataFrame, on: Sequence[str], rows: int = DEALT_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """A scan dealt by ``on`` to tasks of about ``rows`` rows, before row-wise work that outweighs a shuffle.

    Groups within ``on`` then need no shuffle of the longer rows that are made from these, and a task's aggregates stay
    in memory however large the input's splits are. Where a bucket of keys (or of nulls) is too large for a task, rows
    are dealt evenly instead, and later groups are shuffled by all their keys.
    """
    return df.repartition(*dealing(df, on, rows, heavy_rows))


MOST_SPLITS, TASK_BYTES = 1_000, 32 << 20


def fewer_tasks(scan: DataFrame, split_bytes: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A scan in small splits, several to a task: about ``task_bytes`` each where that leaves enough tasks.

    A split's rows stay together and in order, so work by split is as before.
    """
    splits = scan.rdd.getNumPartitions()
    enough = 3 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.coalesce(max(1, min(splits, max(enough, -(-splits * split_bytes // task_bytes)))))


def wider_splits(scan: DataFrame, split_bytes: int, most: int = MOST_SPLITS) -> int:
    """``split_bytes``, or as much more (a task's bytes at most) as brings the scan's splits down to about ``most``.

    Opening a split costs more than reading 64 KB, and what is kept by split would grow with the input.
    """
    splits = scan.rdd.getNumPartitions()
    return max(split_bytes, min(TASK_BYTES, split_bytes * -(-splits // most)))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of every key; each task cuts its groups to one row before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def numbered(
    df: DataFrame, keys: Sequence[str], pos: str, size: Column | None = None, segment: int = 100_000
) -> DataFrame:
    """Add ``_number`` (0-based place by ``pos`` within the key) and ``_total`` (sum of ``size``).

    ``pos`` is a whole number, unique within the key. Rows are numbered inside segments of
    ``segment`` consecutive positions; only the per-segment counts of a key meet in one task, so a
    key with a billion rows is a window over ten thousand counts.
    """
    keys = list(keys)
    size = F.lit(1) if size is None else size
    cut = df.withColumn("_segment", F.floor(F.col(pos) / segment)).withColumn("_size", size)
    counts = cut.groupBy(*keys, "_segment").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_sizes")
    )
    before = Window.partitionBy(*keys).orderBy("_segment")
    offsets = counts.select(
        *keys,
        "_segment",
        (F.sum("_rows").over(before) - F.col("_rows")).alias("_offset"),
        F.sum("_sizes").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_segment").orderBy(pos)
    placed = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    same = [F.col(f"_p.{c}").eqNullSafe(F.col(f"_o.{c}")) for c in [*keys, "_segment"]]  # null keys count too
    return (
        placed.alias("_p").join(offsets.alias("_o"), reduce(and_, same))
        .select("_p.*", "_o._offset", "_o._total")
        .withColumn("_number", F.col("_offset") + F.col("_inside"))
        .drop("_segment", "_size", "_inside", "_offset")
    )


#: ``monotonically_increasing_id`` has the row's place in its partition in these bits, the partition above.
PLACE_BITS = 33


def ranged(df: DataFrame, order: Sequence[Column], name: str, by_range: bool = False) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and stored as it lies, with ``_range`` and ``_place`` (0-based, inside the range).

    ``by_range`` stores each range in a folder of its own, so that a later filter on ``_range`` reads only what it needs.
    """
    at = F.monotonically_increasing_id()
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).select(
        *df.columns, F.shiftright("_at", PLACE_BITS).cast("int").alias("_range"), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1).alias("_place")
    )
    if not by_range:
        return stored(laid, name)
    path = scratch_dir(df.sparkSession, name)
    laid.write.partitionBy("_range").parquet(path)
    return df.sparkSession.read.schema(laid.schema).parquet(path)


def numbered_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``_number``, the 0-based place in ``order`` within the key.

    Rows are dealt by ranges of key and order, so a hot key lies in many ranges; what one key brings together is its
    row count in each range.
    """
    keys = list(keys)
    laid = ranged(df, [F.col(c) for c in [*keys, *order]], name)
    parts = laid.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range")
    parts = parts.withColumn("_before", F.sum("_size").over(before) - F.col("_size") - F.col("_first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*keys, "_range"]]
    joined = laid.alias("l").join(parts.alias("p"), reduce(and_, same)).select("l.*", "p._before")
    return joined.withColumn("_number", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def nest_in_chunks(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, size: int = 10_000
) -> DataFrame:
    """Rows of a key as ordered arrays, one per ``size`` consecutive positions.

    ``pos`` is unique within the key. A key whose positions stay below ``size`` gives one row (chunk 0). A longer one gives several,
    in the order of ``chunk``, so no array outgrows ``size`` while nothing is left out.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), value.alias("value"))))
    return (
        df.groupBy(*keys, F.floor(F.col(pos) / size).alias("chunk"))
        .agg(items.alias("_items"))
        .select(*keys, "chunk", F.transform("_items", lambda i: i["value"]).alias(name))
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read again: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest node (``root``) that edges (``a``, ``b``) of the same ``keys`` reach, for each ``node`` at an edge.

    Every round joins a node with the smallest around it and renames the edges' ends; edges inside one node go. The
    rounds grow with the logarithm of the longest way, each is stored.
    """
    keys = list(keys)
    left = stored(edges.select(*keys, "a", "b").where("a <> b").distinct(), "edges")
    roots = left.select(*keys, F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    while not left.isEmpty():
        ways = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(ways.groupBy(*keys, "a").agg(F.min("b").alias("_b")).select(*keys, "a", F.least("a", "_b").alias("to")), "near")
        far = near.select(*keys, F.col("a").alias("to"), F.col("to").alias("_far"))
        moves = stored(near.join(far, [*keys, "to"]).select(*keys, F.col("a").alias("_from"), F.col("_far").alias("_to")), "moves")
        known = roots.withColumnRenamed("root", "_from").join(moves, [*keys, "_from"], "left")
        known = known.select(*keys, "node", F.coalesce("_to", "_from").alias("root"))
        first = moves.select(*keys, F.col("_from").alias("node"), F.col("_to").alias("root"))
        new = first.join(roots.select(*keys, "node"), [*keys, "node"], "left_anti")
        roots = stored(known.unionByName(new), "roots")
        for end in ("a", "b"):
            left = left.join(moves, [F.col(end) == F.col("_from"), *[left[k].eqNullSafe(moves[k]) for k in keys]]).select(
                *[left[k] for k in keys], *[F.col("_to").alias(c) if c == end else F.col(c) for c in ("a", "b")]
            )
        left = stored(left.where("a <> b").distinct(), "edges")
    return roots
