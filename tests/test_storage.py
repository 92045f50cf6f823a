import datetime
import json
import re
from types import SimpleNamespace

from pyspark.sql import functions as F
import pytest

from gradewright import session
from gradewright.operators import diffs, testlogs
from gradewright.operators.curation import is_valid_release
from gradewright.plans import QUERIES, jobs, storage
from gradewright.sources import documents, keyed, payloads, tables
from gradewright.streaming import incremental


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_results_document(spark, tmp_path):
    doc = {"metadata": {"total_releases": 1}, "results": [{"repository": "o/r", "release": "v1", "enhanced_new_features": []},
                                                          {"repository": "o/s"}]}
    rows = documents.read_results_document(spark, write(tmp_path, "a.json", json.dumps(doc, indent=1))).orderBy("pos").collect()
    assert [(r.pos, r.repository, r.release) for r in rows] == [(0, "o/r", "v1"), (1, "o/s", None)]
    assert documents.read_results_document(spark, write(tmp_path, "b.json", {"metadata": {}})).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.read_results_document(spark, str(tmp_path / "none.json"))
    with pytest.raises(Exception, match="MALFORMED"):
        documents.read_results_document(spark, write(tmp_path, "c.json", "{bad")).collect()


def test_json_readers(spark, tmp_path):
    array = write(tmp_path, "i.json", json.dumps([{"instance_id": "a", "number": 1}, {"instance_id": "b"}], indent=1))
    assert [r.instance_id for r in documents.read_instances_json(spark, array).collect()] == ["a", "b"]
    crawl = write(tmp_path, "crawl.json", json.dumps({"web": ["a/b", "c/d"], "ml": ["a/b"]}, indent=1))
    assert sorted(r.repo for r in documents.read_crawl_list(spark, crawl).collect()) == ["a/b", "a/b", "c/d"]
    cache = write(tmp_path, "cache.json", {"k#1": {"n": 1}, "k#2": {"n": None}})
    assert sorted(map(tuple, documents.read_keyed_cache(spark, cache, "n int").collect())) == [("k#1", 1), ("k#2", None)]
    for path in (str(tmp_path / "missing.json"), write(tmp_path, "broken.json", "{oops")):
        assert documents.read_keyed_cache(spark, path, "n int").count() == 0
    patch = write(tmp_path, "p.diff", "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\n")
    assert documents.read_patch_files(spark, patch).first().diff.endswith("+b\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.read_patch_files(spark, str(tmp_path / "no.diff"))


def test_payloads(spark):
    landing = spark.createDataFrame([("r", '{"full_name": "a/b"}'), ("r", "oops")], "repo string, payload string")
    rows = payloads.ingest_repo_payload(landing).collect()
    assert [(r.full_name, r.topics, r.language, r.archived) for r in rows] == [("a/b", [], "", False)]
    from gradewright.schemas import REPO_PAYLOAD

    assert payloads.rejected_payloads(landing, REPO_PAYLOAD).count() == 1
    text = spark.createDataFrame([("aMOp\nbGxv\n",), ("/wD+",), (None,), ("abc",)], "content_b64 string")
    got = [r.content for r in payloads.ingest_file_contents(text).collect()]
    assert got == ["héllo", None, None, None]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 9), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    once = tables.upsert_keyed_cache(old, new, ["k"], "seq")
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 3), ("b", 1), ("c", 4)]
    twice = tables.upsert_keyed_cache(once, new, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_batches_and_compaction(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "u")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    tables.append_batch(rows, path, 0)
    for _ in range(2):  # a repeated batch replaces itself
        tables.append_batch(rows.where("k = 'a'").withColumn("v", F.lit(2)), path, 10)
    tables.append_batch(rows.where("k = 'b'").withColumn("v", F.lit(7)), path, 9)
    want = [("a", 2), ("b", 7)]
    assert sorted(map(tuple, tables.read_keyed(spark, path, ["k"]).collect())) == want
    tables.compact_keyed(spark, path, target, ["k"])
    assert sorted(map(tuple, tables.read_keyed(spark, target, ["k"]).collect())) == want


def test_results_store(spark, tmp_path):
    results, keys = tables.load_results(spark, str(tmp_path / "none"))
    assert results.count() == keys.count() == 0
    rows = spark.createDataFrame([("a", "i"), ("a", "i"), ("b", "i")], "agent string, instance_id string")
    tables.save_results(rows, str(tmp_path / "r"), "x")
    results, keys = tables.load_results(spark, str(tmp_path / "r"))
    assert (results.count(), keys.count()) == (3, 2)


def test_stream_upsert_continues(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "k string, v int"
    for batch in ([("a", 1), ("a", 2), ("b", 1)], [("a", 0), ("b", 5)]):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        incremental.stream_upsert_keyed(stream, out, state, ["k"], "v").awaitTermination()
    # the later batch wins, whatever its values
    assert sorted(map(tuple, tables.read_keyed(spark, out, ["k"], "v").collect())) == [("a", 0), ("b", 5)]


def test_a_new_stream_replaces_no_batch_of_another(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "k string, v int"
    tables.append_batch(spark.createDataFrame([("x", 1), ("a", 0)], ddl), out, 0)
    for state, batch in (("one", [("a", 1)]), ("one", [("b", 1)]), ("two", [("c", 3)])):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        incremental.stream_upsert_keyed(stream, out, str(tmp_path / state), ["k"], "v").awaitTermination()
    got = sorted(map(tuple, tables.read_keyed(spark, out, ["k"], "v").collect()))
    assert got == [("a", 1), ("b", 1), ("c", 3), ("x", 1)]
    with pytest.raises(ValueError, match="whole number"):
        tables.append_batch(spark.createDataFrame([("x", 1)], ddl), out, "b10")


class FakeSession:
    """The two settings that decide where scratch folders go."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master)


def test_scratch_follows_the_session():
    shared = session.scratch_dir(FakeSession("/shared/x/", "yarn"), "n")
    assert shared.startswith("/shared/x/n-")
    assert "gradewright/n-" in session.scratch_dir(FakeSession(None, "local[2]"), "n")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(FakeSession(None, "yarn"), "n")


def test_streamed_releases_come_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "repo string, tag_name string, published_at string, body string, author struct<login string>"
    day = "2025-01-{:02d}T00:00:00Z".format
    body = "b" * 60
    batches = [
        [("r", "v1", day(1), body, None), ("r", "v1", day(1), body, None), ("r", "v2", day(2), "short", None)],
        [("r", "v1", day(1), body, None), ("s", "v1", day(3), body, ("dependabot[bot]",)), ("s", "v2", day(3), body, None)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        fresh = incremental.stream_new_releases(stream, is_valid_release()).select("repo", "tag_name")
        incremental.append_to(fresh, out, state).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("r", "v1"), ("s", "v2")]


def test_streamed_progress_waits_for_complete_windows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "agent string, finished_at timestamp, success boolean"
    at = lambda minute: datetime.datetime(2025, 1, 1, 0, minute)
    batches = [[("a", at(1), True), ("a", at(2), False)], [("a", at(9), None), ("b", at(45), True)], [("a", at(3), True)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        windows = incremental.stream_eval_progress(spark.readStream.schema(ddl).parquet(src))
        incremental.append_to(windows, out, state).awaitTermination()
    rows = [(r.agent, r.n, r.resolved) for r in spark.read.parquet(out).collect()]
    assert rows == [("a", 3, 1)]  # the last batch came too late, the window of b is still open


def test_pages_are_read_or_rejected(spark):
    pages = ['[{"tag_name": "a"}, {"tag_name": "b"}]', '[{"tag_name": "a"}, {"tag', "<html>", "", None, "[]", '{"message": "rate limited"']
    landing = spark.createDataFrame([(f"r{k}", str(k), p) for k, p in enumerate(pages)], "repo string, pr_number string, payload string")
    for ingest, rejected in (
        (payloads.ingest_releases_payload, payloads.rejected_releases_payload),
        (payloads.ingest_pr_files_payload, payloads.rejected_pr_files_payload),
    ):
        assert sorted(r.repo for r in ingest(landing).collect()) == ["r0", "r0"]
        assert sorted(r.repo for r in rejected(landing).collect()) == ["r1", "r2", "r3", "r4", "r6"]  # r5 has no items


def folders(path):
    return {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in path.glob("buckets=*/bucket=*")}


def test_an_update_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.lit(1).alias("seq"))
    keyed.upsert_buckets(rows, str(path), ["k"], "seq", 0, buckets=8)
    before = folders(path)
    new = spark.createDataFrame([("k3", 1000, 1), ("k3", 1001, 2), ("new", 5, 1)], "k string, v long, seq int")
    keyed.upsert_buckets(new, str(path), ["k"], "seq", 1, buckets=8)
    after = folders(path)
    assert len(before) == 8 and 1 <= sum(after[b] != before[b] for b in before) <= 2
    want = {f"k{i}": i for i in range(400)} | {"k3": 1001, "new": 5}
    assert {r.k: r.v for r in keyed.read_buckets(spark, str(path)).collect()} == want
    keyed.upsert_buckets(new, str(path), ["k"], "seq", 1, buckets=8)  # once more
    keyed.upsert_buckets(rows.where("id < 9"), str(path), ["k"], "seq", 0, buckets=8)  # and an old one
    assert {r.k: r.v for r in keyed.read_buckets(spark, str(path)).collect()} == want
    assert keyed.read_buckets(spark, str(path)).columns == ["k", "v", "seq"] and keyed.next_batch(spark, str(path)) == 2
    with pytest.raises(ValueError, match="8 buckets"):
        keyed.upsert_buckets(new, str(path), ["k"], "seq", 2, buckets=4)


def test_large_buckets_are_merged_in_parts(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('k', id % 60) AS k", "concat('m', id) AS m", "id AS v", "1 AS seq")
    more = spark.range(250, 400).selectExpr("concat('k', id % 60) AS k", "concat('m', id) AS m", "-id AS v", "2 AS seq")
    more = more.unionByName(spark.createDataFrame([(None, "m", 7, 2), ("k", None, 8, 2)], "k string, m string, v long, seq int"))
    path = tmp_path / "t"
    for batch, updates in enumerate((rows, more, rows)):  # the last comes late
        keyed.upsert_buckets(updates, str(path), ["k", "m"], "seq", min(batch, 1), by_batch=False, buckets=4, by=["k"], part_rows=10)
        files = [len(list(p.glob("*.parquet"))) for p in path.glob("buckets=4/bucket=*")]
        assert len(files) == 4 and max(files) > 2
    want = {("k%d" % (i % 60), f"m{i}"): i if i < 250 else -i for i in range(400)} | {(None, "m"): 7, ("k", None): 8}
    found = keyed.read_buckets(spark, str(path)).collect()
    assert {(r.k, r.m): r.v for r in found} == want and len(found) == len(want)
    buckets = spark.read.parquet(str(path)).groupBy("k").agg(F.countDistinct("bucket").alias("n"))
    assert {r.n for r in buckets.collect()} == {1}
    with pytest.raises(ValueError, match="not chosen by k, m"):
        keyed.upsert_buckets(rows, str(path), ["k", "m"], "seq", 2, by_batch=False, buckets=4)


def test_stored_statuses_are_shuffled_once(spark, tmp_path):
    rows = [(f"i{i}", kind, phase, 1, f"PASSED t.py::a[{i}]") for i in range(9) for kind in ("f2p", "p2p") for phase in ("before", "after")]
    jobs.store_statuses(spark.createDataFrame(rows, "instance_id string, kind string, phase string, batch long, log string"), str(tmp_path / "s"), buckets=4)
    asked = spark.createDataFrame([("i1", "t.py::a")], "instance_id string, selector string")
    labels = jobs.labels_of_statuses(spark, str(tmp_path / "s"), asked)
    text = labels._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in text and not any("max_by" in e for e in re.findall(r".*Exchange hashpartitioning.*\n.*\n", text))
    assert labels.count() == 9


def test_statuses_in_two_updates_equal_one_run(spark, tmp_path):
    lines = "== short test summary info ==\n"
    logs = [("i", "p2p", phase, b, f"{lines}{status} t.py::a\nPASSED t.py::b[{b}]\n") for b, (phase, status) in enumerate(
        [("before", "FAILED"), ("after", "FAILED"), ("before", "PASSED"), ("after", "PASSED"), ("before", "PASSED")])]
    df = spark.createDataFrame(logs, "instance_id string, kind string, phase string, batch long, log string")
    asked = spark.createDataFrame([("i", "t.py::a")], "instance_id string, selector string")
    found = []
    for name, parts in (("one", ["true"]), ("two", ["batch < 2", "batch >= 2", "batch < 2"]), ("late", ["batch >= 2", "batch < 2"])):
        for number, part in enumerate(parts):
            jobs.store_statuses(df.where(part), str(tmp_path / name), number, buckets=4)
        found.append(sorted(map(tuple, jobs.labels_of_statuses(spark, str(tmp_path / name), asked).collect())))
    assert found[0] == found[1] == found[2] == [("i", "p2p", "t.py::a"), ("i", "p2p", "t.py::b")]


def test_streamed_buckets_go_on_from_other_updates(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "k string, v int"
    keyed.upsert_buckets(spark.createDataFrame([("x", 1), ("a", 9)], ddl), out, ["k"], "v", 4, buckets=4)
    for batch in ([("a", 1), ("a", 2), ("b", 1)], [("a", 0), ("b", 5)]):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        incremental.stream_upsert_buckets(stream, out, str(tmp_path / "state"), ["k"], "v", buckets=4).awaitTermination()
    assert sorted(map(tuple, keyed.read_buckets(spark, out).collect())) == [("a", 0), ("b", 5), ("x", 1)]


def test_a_second_result_replaces_the_first(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "agent string, instance_id string, finished_at timestamp, success boolean"
    at = lambda minute: datetime.datetime(2025, 1, 1, 0, minute)
    batches = [[("a", "i", at(1), True), ("a", "j", at(2), False), ("b", "i", at(1), None)], [("a", "i", at(9), False), ("a", "j", at(1), True)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        incremental.stream_eval_results(spark.readStream.schema(ddl).parquet(src), out, state, 4).awaitTermination()
    rows = incremental.progress_of(keyed.read_buckets(spark, out)).collect()
    assert sorted((r.agent, r.n, r.resolved) for r in rows) == [("a", 2, 0), ("b", 1, 0)]


def test_late_first_arrivals_pass_and_repeats_do_not(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "repo string, tag_name string, published_at string"
    for batch in (
        [("r", "v1", "2025-06-01T00:00:00Z"), ("r", "v1", "2025-05-01T00:00:00Z"), ("r", "v2", None)],
        [("r", "v0", "1999-01-01T00:00:00Z"), ("r", "v1", "2026-01-01T00:00:00Z"), ("r", "v2", "2025-01-01T00:00:00Z")],
    ):  # the second run starts again from the checkpoint
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        fresh = incremental.stream_new_releases(spark.readStream.schema(ddl).parquet(src), F.lit(True))
        incremental.append_to(fresh.select("repo", "tag_name", "published"), out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.repo, r.tag_name) for r in rows) == [("r", "v0"), ("r", "v1"), ("r", "v2")]
    assert {r.published and r.published.year for r in rows} == {1999, 2025, None}


@pytest.mark.parametrize("block", [9, 400])
def test_patch_records_equal_whole_files(spark, tmp_path, block):
    one = "diff --git a/x{k}.py b/x{k}.py\n--- a/x{k}.py\n+++ b/x{k}.py\n@@ -1 +1 @@\n-é{k}\n+diff --git {k}\n"
    for name, head in (("a.txt", ""), ("b.txt", "From: x\n\n"), ("c.txt", "\n")):
        write(tmp_path, name, head + "".join(one.format(k=k) for k in range(30)))
    glob = str(tmp_path / "*.txt")
    want = diffs.parse_unified_diff(documents.read_patch_files(spark, glob), id="path")
    got = diffs.parse_chunks(documents.read_patch_records(spark, glob, block))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.withColumn("pos", F.col("pos").cast("long")).collect()))
    lines = documents.read_log_lines(spark, str(tmp_path / "a.txt"), block).orderBy("line_no").collect()
    assert [r.line for r in lines] == "".join(one.format(k=k) for k in range(30)).splitlines() and lines[-1].line_no == 179


def test_logs_as_lines_equal_logs_as_cells(spark):
    heading = "=== short test summary info ==="
    logs = {
        "a": f"PASSED t.py::early\n{heading}\nFAILED t.py::x - why\n{heading}\n\x1b[31mPASSED\x1b[0m t.py::y\n", "b": "PASSED t.py::no_heading\nnoise",
        "c": f"{heading}\n" + "".join(f"PASSED t.py::h[{k}]\n" for k in range(3000)), "d": "",
    }
    cells = spark.createDataFrame(list(logs.items()), "k string, log string")
    lines = cells.select("k", F.posexplode(F.split("log", "\n")).alias("line_no", "line"))
    want = testlogs.parse_test_log(cells)
    assert sorted(map(tuple, testlogs.parse_log_lines(lines, ["k"]).collect())) == sorted(map(tuple, want.collect()))


def test_log_lines_in_one_pass_equal_the_join(spark):
    heading = "=== short test summary info ==="
    logs = [("a", 1, f"PASSED t.py::early\n{heading}\nFAILED t.py::x - why\n{heading}\n\x1b[31mPASSED\x1b[0m t.py::y\n"),
            ("b", 1, "PASSED t.py::no_heading\nnoise"), ("a", 2, f"PASSED t.py::z\nPASSED {heading}\nERROR u"), ("a", 2, "PASSED t.py::z\nERROR v"),
            (None, 1, f"PASSED t.py::early\n{heading}\nPASSED t.py::late"), ("c", None, f"{heading}\n" * 2 + "FAILED w")]
    cells = spark.createDataFrame(logs, "k string, n int, log string").repartition(3, "k")
    lines = cells.select("k", "n", F.posexplode(F.split("log", "\n")).alias("line_no", "line"))
    joined, windowed = (testlogs.parse_log_lines(lines, ["k", "n"], together=t) for t in (False, True))
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, windowed.collect())) == sorted(map(str, joined.collect()))
    assert plan.count("Exchange") == 1 and "Join" not in plan  # the shuffle that deals the cells


def test_an_update_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(k):
        seen.add(1)
        return f"k{k}"

    path = str(tmp_path / "table")
    for number in range(2):
        before = seen.value
        rows = spark.range(20).repartition(1).select(key("id").alias("k"), (F.col("id") + 100 * number).alias("v"))
        keyed.upsert_buckets(rows, path, ["k"], "v", number, by_batch=False, buckets=4, unique=True)
        assert seen.value - before == 20
    assert sorted(r.v for r in keyed.read_buckets(spark, path).collect()) == list(range(100, 120))


def test_last_lines_keep_the_status_of_a_line_without_place(spark):
    rows = [("a", "PASSED", None), ("b", "PASSED", None), ("b", "FAILED", 1), ("b", "SKIPPED", 2), (None, "ERROR", 3)]
    lines = spark.createDataFrame(rows, "test string, status string, pos long").withColumn("pos", F.col("pos").cast("decimal(38,0)"))
    found = {r.test: (r.status, r.pos) for r in testlogs.last_lines(lines, ["test"]).collect()}
    assert found == {"a": ("PASSED", None), "b": ("SKIPPED", 2), None: ("ERROR", 3)}


def test_results_documents_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda spark, name: str(tmp_path / name))
    QUERIES["read_results_document"](spark, "/root/testdata/sf0.001")
    files = [f.name for f in tmp_path.glob("results/part-*")]
    assert files and all(f.endswith(".gz") for f in files)
