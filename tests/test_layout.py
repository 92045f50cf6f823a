import random

from pyspark.sql import functions as F
import pytest

from gradewright.operators import labels, layout


@pytest.fixture
def hot(spark):
    """A key with a third of all rows, a null key, and many small keys."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, v int")
    salted = layout.skew_join(hot, right, ["k"], how, heavy_rows=100, salts=8)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, hot.join(right, "k", how).collect()))


def test_hot_keys_are_spread(spark, hot):
    assert [r["_excess"] for r in layout.heavy_keys(hot, ["k"], 100).collect()] == [10]
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = layout.skew_join(hot, right, ["k"], "inner", heavy_rows=100, salts=16)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 600


def test_no_hot_key_is_missed(spark):
    keys = spark.range(2_000 * 12).select((F.col("id") % 2_000).alias("k"))  # more hot keys than any old bound
    assert layout.heavy_keys(keys, ["k"], 5).count() > 1_900


def test_identical_rows_of_a_hot_key_are_spread(spark):
    same = spark.range(3000).select(F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert layout.skew_join(same, right, ["k"], "inner", heavy_rows=100, salts=16).count() == 3000
    ids = same.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("s"))
    assert ids.distinct().count() == 16


def test_numbered_keeps_null_keys(spark, hot):
    got = layout.numbered(hot, ["k"], "id", segment=70)
    assert got.count() == hot.count()
    nulls = sorted(r["_number"] for r in got.where("k IS NULL").collect())
    assert nulls == list(range(len(nulls)))


def test_numbered_equals_row_number(spark, hot):
    from pyspark.sql import Window

    got = layout.numbered(hot, ["k"], "id", F.lit(2), segment=70)
    w = Window.partitionBy("k").orderBy("id")
    want = hot.where("k IS NOT NULL").select(
        "k", "id", (F.row_number().over(w) - 1).alias("_number"),
        (F.count("*").over(Window.partitionBy("k")) * 2).alias("_total"))
    rows = got.where("k IS NOT NULL").select("k", "id", "_number", "_total").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))


def test_chunks_hold_everything_in_order(spark, hot):
    nested = layout.nest_in_chunks(hot, ["k"], "id", F.col("id"), "ids", size=500).collect()
    assert max(len(r.ids) for r in nested) <= 500
    assert sorted(i for r in nested for i in r.ids) == list(range(3000))
    assert all(r.ids == sorted(r.ids) for r in nested)


def test_long_label_lists_go_on_in_chunks(spark):
    rows = [("big", "f2p", f"t{i:02d}") for i in range(30)] + [("small", "f2p", "b"), ("small", "f2p", "a"), ("small", "p2p", "c")]
    df = spark.createDataFrame(rows, "instance_id string, kind string, test string")
    texts = {(r.instance_id, r.chunk): (r.FAIL_TO_PASS, r.PASS_TO_PASS) for r in labels.label_strings(df, size=10).collect()}
    assert texts["small", 0] == ("a, b", "c")
    assert ", ".join(texts["big", k][0] for k in range(3)) == ", ".join(f"t{i:02d}" for i in range(30)) and len(texts) == 4


def test_labels_of_a_hot_instance_are_spread(spark):
    rows = [("big", "f2p", f"t{i:04d}") for i in range(2000)] + [(f"s{i % 50}", "p2p", f"u{i}") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:5], "instance_id string, kind string, test string")
    placed = layout.numbered_in_order(df.distinct(), ["instance_id", "kind"], ["test"], "test-order")
    assert sorted(r._number for r in placed.where("instance_id = 'big'").collect()) == list(range(2000))
    assert all(int(r.test[1:]) == r._number for r in placed.where("instance_id = 'big'").collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        laid = layout.ranged(df, [F.col("instance_id"), F.col("kind"), F.col("test")], "test-ranges")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert laid.where("instance_id = 'big'").select("_range").distinct().count() >= 3
    plan = labels.label_strings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_size" in line for line in plan.splitlines() if "Window" in line)  # over counts alone


def test_salts_do_not_depend_on_the_order_of_rows(spark, hot):
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    plan = layout.skew_join(hot, right, ["k"], heavy_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64(k" in plan


def test_last_per_key_ignores_partitioning(spark, hot):
    want = {tuple(r) for r in layout.last_per_key(hot, ["k"], ["id"]).collect()}
    assert want == {tuple(r) for r in layout.last_per_key(hot.repartition(7), ["k"], ["id"]).collect()}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.choice("pq"), f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(70)] + [("p", f"c{k:03}", f"c{k + 1:03}") for k in range(100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in edges:
        parent[root((k, a))] = root((k, b))
    least = {}
    for x in list(parent):
        least[root(x)] = min(least.get(root(x), x), x)
    want = {x: least[root(x)][1] for x in parent if sum(root(y) == root(x) for y in parent) > 1}
    got = layout.components(spark.createDataFrame(edges, "k string, a string, b string"), ["k"])
    assert {(r.k, r.node): r.root for r in got.collect()} == want
    assert layout.components(spark.createDataFrame([], "k string, a string, b string"), ["k"]).count() == 0


def test_dealt_keeps_a_key_in_one_task(spark):
    rows = spark.range(3000).select(F.nullif(F.col("id") % 40, F.lit(7)).alias("k"), "id")
    dealt = layout.dealt(rows, ["k"], rows=200)
    assert dealt.rdd.getNumPartitions() == 15
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().count() == 40
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    assert "Exchange" in dealt._jdf.queryExecution().executedPlan().toString()
    grouped = dealt.groupBy("k", "id").count()._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange hashpartitioning") == 1


def test_dealt_spreads_a_hot_key(spark, hot):
    dealt = layout.dealt(hot, ["k"], rows=200, heavy_rows=500)
    assert dealt.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() == 15
    assert sorted(map(str, dealt.collect())) == sorted(map(str, hot.collect()))


def test_counting_heavy_keys_shares_the_shuffle(spark, hot):
    plan = layout.heavy_keys(hot.distinct(), ["k"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1  # that of the result
    assert layout.heavy_keys(spark.createDataFrame([(None,)] * 50, "k string"), ["k"], 5).count() == 0


def test_tables_dealt_alike_need_no_further_shuffle(spark, hot):
    assert layout.dealing(hot.where("k IS NOT NULL"), ["k"], rows=200, heavy_rows=500) == (15,)
    small = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 900).alias("k"), "id")
    deal = layout.dealing(small, ["k"], rows=200)
    assert deal == (20, "k")
    both = small.repartition(*deal).unionByName(small.withColumn("id", -F.col("id")).repartition(*deal))
    assert both.groupBy("k", "id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
