import json
import random

from pyspark.sql import functions as F
import pytest

from gradewright.operators import judging, labels, testlogs, usage

LOG = "t string"


def statuses(spark, log):
    df = spark.createDataFrame([("i", "before", log)], "instance_id string, phase string, log string")
    found = testlogs.last_status_per_test(testlogs.parse_test_log(df))
    return {r.test: r.status for r in found.collect()}


def test_summary_lines(spark):
    log = ("FAILED early.py::x\n\x1b[1m== short test summary info ==\x1b[0m\nPASSED tests/t.py::a[1]\r\n"
           "  \x1b[31mFAILED\x1b[0m tests/t.py::a[2] - boom - bang\nSKIPPED [1] t.py:3: why\nXFAIL t.py::b\n"
           "ERROR\ttests/t.py::c -x\nPASSED a - \nPASSED\nPASSED  tests/u.py::d e  - m\nPASSEDx y\nnot PASSED z")
    assert statuses(spark, log) == {
        "tests/t.py::a[1]": "PASSED", "tests/t.py::a[2]": "FAILED", "[1] t.py:3: why": "SKIPPED",
        "tests/t.py::c -x": "ERROR", "a -": "PASSED", "tests/u.py::d e": "PASSED"}


def test_whole_log_without_summary_and_last_line_wins(spark):
    assert statuses(spark, "x\nPASSED a\nFAILED a\nPASSED b") == {"a": "FAILED", "b": "PASSED"}
    assert statuses(spark, "") == {}


def outcomes(spark, pairs):
    return spark.createDataFrame([("i", t, s) for t, s in pairs], "instance_id string, test string, status string")


@pytest.mark.parametrize("seen, want", [
    ("PS", "PASSED"), ("PF", "FAILED"), ("SS", "SKIPPED"), ("PE", "FAILED"), ("PU", "FAILED"), ("P", "PASSED"),
])
def test_parameters_combine(spark, seen, want):
    full = dict(zip("PFSEU", testlogs.STATUSES[:2] + ("SKIPPED", "ERROR", "UNKNOWN")))
    df = outcomes(spark, [(f"t[{i}]", full[c]) for i, c in enumerate(seen)])
    assert testlogs.aggregate_param_status(df, ["instance_id"]).first().status == want


def test_resolve(spark):
    df = outcomes(spark, [("a[1]", "PASSED"), ("a[2]", "FAILED"), ("b", "SKIPPED"), ("c[1]", "PASSED")])
    asked = spark.createDataFrame([("i", s) for s in ("a[1]", "a", "a[9]", "b", "c", "z")], "instance_id string, selector string")
    got = {r.selector: r.status for r in testlogs.resolve_test_status(asked, df).collect()}
    assert got == {"a[1]": "PASSED", "a": "FAILED", "a[9]": "FAILED", "b": "SKIPPED", "c": "PASSED", "z": "UNKNOWN"}


def test_selectors_resolved_together_equal_the_joins(spark):
    """Nulls, repeats, statuses that are null or odd, and a column of the selectors' own."""
    rng = random.Random(8)
    tests, ids = ["a", "a[1]", "a[2]", "b[1]", "c", "d[x][y]", "", None], [*[f"i{k}" for k in range(30)], None]
    statuses = ["PASSED"] * 4 + ["FAILED", "SKIPPED", "SKIPPED", "ERROR", "UNKNOWN", "XFAIL", None]
    seen = spark.createDataFrame([(i, t, rng.choice(statuses)) for i in ids for t in tests if rng.random() < 0.5],
                                 "instance_id string, test string, status string")
    asked = spark.createDataFrame([(n, t, rng.choice(ids + ["none"])) for n, t in enumerate(3 * tests * 12 + ["e", "a[9]", "b"] * 20)],
                                  "n int, selector string, instance_id string")
    found = testlogs.resolve_test_status(asked, seen, together=True)
    want = testlogs.resolve_test_status(asked, seen)
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_labels(spark):
    before = outcomes(spark, [("a", "FAILED"), ("b", "PASSED"), ("d", "ERROR"), ("e", "SKIPPED")])
    after = outcomes(spark, [("a", "PASSED"), ("b", "PASSED"), ("c", "PASSED"), ("d", "PASSED"), ("e", "PASSED")])
    assert {r.test for r in labels.fail_to_pass(before, after).collect()} == {"a", "d"}
    assert {r.test for r in labels.pass_to_pass(before, after).collect()} == {"b"}
    lines = before.withColumn("phase", F.lit("before")).unionByName(after.withColumn("phase", F.lit("after")))
    kinds = F.explode(F.array(F.lit("f2p"), F.lit("p2p"))).alias("kind")
    asked = spark.createDataFrame([("i", s) for s in "abcdez"], "instance_id string, selector string")
    found = labels.derive_labels(asked, lines.select("*", F.lit(1).alias("pos"), kinds))
    assert {(r.kind, r.test) for r in found.collect()} == {("f2p", "a"), ("f2p", "d"), ("p2p", "b")}


def test_labels_are_of_changed_tests_with_all_their_parameters(spark):
    """A half-fixed test is no fail-to-pass; a test that was not changed is none either; a kind has its own logs."""
    rows = [("f2p", "before", "f[1]", "FAILED"), ("f2p", "before", "f[2]", "FAILED"), ("f2p", "after", "f[1]", "PASSED"),
            ("f2p", "after", "f[2]", "FAILED"), ("f2p", "before", "g[1]", "ERROR"), ("f2p", "before", "g[2]", "PASSED"),
            ("f2p", "after", "g[1]", "PASSED"), ("f2p", "after", "g[2]", "SKIPPED"), ("f2p", "before", "u", "FAILED"),
            ("f2p", "after", "u", "PASSED"), ("p2p", "before", "v", "PASSED"), ("p2p", "after", "v", "PASSED"),
            ("f2p", "before", "new", "ERROR"), ("f2p", "before", "w", "PASSED"), ("f2p", "after", "w", "PASSED")]
    lines = spark.createDataFrame([("i", 1, *r) for r in rows], "instance_id string, pos int, kind string, phase string, test string, status string")
    asked = spark.createDataFrame([("i", s) for s in ("f", "g", "f[1]", "new", "v")], "instance_id string, selector string")
    found = labels.derive_labels(asked, lines)
    assert {(r.kind, r.test) for r in found.collect()} == {("f2p", "g"), ("f2p", "f[1]"), ("p2p", "v")}
    for phase in ("before", "after"):
        last = lines.where(f"kind = 'f2p' AND phase = '{phase}'").select("instance_id", "test", "status")
        status = {r.selector: r.status for r in testlogs.resolve_test_status(asked, last).collect()}
        assert (status["g"], status["f[1]"], status["f"]) == (("FAILED", "FAILED", "FAILED") if phase == "before" else ("PASSED", "PASSED", "FAILED"))


def test_labels_equal_their_rule_on_any_lines(spark):
    """Against the rule by dictionaries: selectors with and without parameters, gaps, nulls, repeats, odd kinds."""
    rng = random.Random(5)
    tests, kinds = ["a", "a[1]", "a[2]", "b[1]", "b[2]", "b[]", "c", "d[x][y]", None], ["f2p", "p2p", "other", None]
    ids = [*[f"i{k}" for k in range(60)], None]
    rows = [(rng.choice(ids), rng.choice(kinds[:2] * 4 + kinds), rng.choice(["before", "after"] * 3 + ["later"]), pos, rng.choice(tests),
             rng.choice(["PASSED"] * 4 + ["FAILED"] * 3 + ["SKIPPED", "ERROR", "UNKNOWN", "XFAIL", None])) for pos in range(900)]
    lines = spark.createDataFrame(rows, "instance_id string, kind string, phase string, pos int, test string, status string")
    asked = [(i, t) for i in [*ids, "none"] for t in [*tests, "a", "a[9]", "b", "d", "e[1]"] if rng.random() < 0.8]
    last = {}
    for i, kind, phase, _pos, test, status in rows:
        if None not in (i, kind, test):
            last.setdefault((i, kind, phase, test), None)
            last[i, kind, phase, test] = status if status is not None else "null"

    def whole(i, kind, phase, base):
        seen = {s for (i2, k2, p2, t), s in last.items() if (i2, k2, p2, t.split("[")[0]) == (i, kind, phase, base) and s != "null"}
        return None if not seen else "FAILED" if seen & {"FAILED", "ERROR", "UNKNOWN"} else "PASSED" if "PASSED" in seen else "SKIPPED"

    def status(i, phase, test):
        exact = last.get((i, "f2p", phase, test))
        return exact if exact not in (None, "null") else whole(i, "f2p", phase, test.split("[")[0])

    want = [("f2p", i, t) for i, t in sorted({p for p in asked if None not in p}) if status(i, "before", t) in ("FAILED", "ERROR")
            and status(i, "after", t) == "PASSED"]
    bases = {(i, kind, t.split("[")[0]) for i, kind, _phase, t in last if kind != "f2p"}
    want += [("p2p", i, b) for i, kind, b in bases if whole(i, kind, "before", b) == whole(i, kind, "after", b) == "PASSED"]
    got = labels.derive_labels(spark.createDataFrame(asked, "instance_id string, selector string"), lines)
    assert sorted((r.kind, r.instance_id, r.test) for r in got.collect()) == sorted(want) and len(want) > 8
    assert any("[" in t for _k, _i, t in want)


def test_order_of_lines_never_mixes_logs(spark):
    df = spark.createDataFrame([(1, 2**31 - 1), (2, 0), (2**62, 5)], "batch long, pos int")
    order = [r[0] for r in df.select(testlogs.log_order(F.col("batch"), F.col("pos"))).collect()]
    assert order == sorted(order) and len(set(order)) == 3


def test_mining_labels_marks_each_pending_spec(spark, monkeypatch):
    from gradewright.plans import jobs

    specs = spark.createDataFrame(
        [("a", None, None, None), ("same", "x", "y", False), ("wait", None, None, False), ("done", "x", "y", True)],
        "instance_id string, FAIL_TO_PASS string, PASS_TO_PASS string, processed boolean")
    body = "def test_f():\n    return {}\n"
    files = spark.createDataFrame(
        [(i, "t.py", body.format(0), body.format(int(i != "same"))) for i in ("a", "same", "wait", "done")],
        "instance_id string, path string, before string, after string")
    suite = "\n".join(f"PASSED t.py::s{k}" for k in range(25))
    rows = [("a", kind, phase, 0, text) for kind, phase, text in (
        ("f2p", "before", "FAILED t.py::test_f"), ("f2p", "after", "PASSED t.py::test_f"), ("p2p", "before", suite), ("p2p", "after", suite))]
    logs = spark.createDataFrame(rows, "instance_id string, kind string, phase string, batch long, log string")
    monkeypatch.setattr(labels.label_strings, "__defaults__", (10,))
    new, more = jobs.mine_labels(specs, files, logs)
    got = {r.instance_id: r for r in new.collect()}
    assert got["a"].processed and got["a"].FAIL_TO_PASS == "t.py::test_f" and got["a"].PASS_TO_PASS.count(",") == 9
    assert [(r.chunk, r.PASS_TO_PASS.count(",") + 1) for r in more.orderBy("chunk").collect()] == [(1, 10), (2, 5)]
    assert (got["same"].FAIL_TO_PASS, got["same"].processed) == ("x", True)
    assert not got["wait"].processed and got["done"].PASS_TO_PASS == "y"


def test_update_labels_overwrites_with_null(spark):
    ddl = "instance_id string, FAIL_TO_PASS string, PASS_TO_PASS string, processed boolean"
    specs = spark.createDataFrame([("a", "x", "y", None), ("b", "x", "y", None)], ddl)
    new = spark.createDataFrame([("a", None, "p")], "instance_id string, FAIL_TO_PASS string, PASS_TO_PASS string")
    got = sorted(tuple(r) for r in labels.update_labels(specs, new).collect())
    assert got == [("a", None, "p", True), ("b", "x", "y", False)]
    pending = spark.createDataFrame([("a", "", None, True), ("b", "", "", None)], ddl)
    assert [r.instance_id for r in labels.filter_pending_specs(pending, test_only=True).collect()] == ["a"]
    assert [r.instance_id for r in labels.filter_pending_specs(pending).collect()] == ["b"]


def test_judging(spark):
    ids = spark.createDataFrame([("none",), ("half",), ("full",)], "instance_id string")
    ddl = "instance_id string, kind string, test string"
    want = spark.createDataFrame([("half", "f2p", "a"), ("half", "f2p", "b"), ("full", "p2p", "a")], ddl)
    got = spark.createDataFrame([("half", "f2p", "a"), ("half", "p2p", "b"), ("full", "p2p", "a"), ("full", "f2p", "q")], ddl)
    rows = {r.instance_id: (r.success_f2p, r.success_p2p, r.success)
            for r in judging.judge_expected_tests(ids, want, got).collect()}
    assert rows == {"none": (True, True, True), "half": (False, True, False), "full": (True, True, True)}


def test_batches(spark):
    df = spark.range(600).select(F.lit("i").alias("instance_id"), F.col("id").alias("pos"), F.lit("x" * 9).alias("selector"))
    few = testlogs.assign_batches(df, base_len=0, limit=6000)
    assert few.agg(F.max("batch")).first()[0] == 0
    many = testlogs.assign_batches(df, base_len=1, limit=6000)
    assert [r["count"] for r in many.groupBy("batch").count().orderBy("batch").collect()] == [250, 250, 100]


def tokens(one, parser, log):
    return tuple(one(parser, log))


TWO = '{"usage": {"input_tokens": 10, "output_tokens": 5}}\nnoise\n{"usage": {"input_tokens": 20, "output_tokens": 7}}'


def test_usage_parsers(one):
    assert tokens(one, usage.usage_last_json, TWO) == (20, 7, 27)
    assert tokens(one, usage.usage_sum_json, TWO) == (30, 12, 42)
    stats = {"stats": {"models": {"m1": {"tokens": {"input": 3, "candidates": 2, "total": 5}}, "m2": {"tokens": {"input": 1}}}}}
    assert tokens(one, usage.usage_model_stats, json.dumps(stats)) == (4, 2, 5)
    assert tokens(one, usage.usage_model_stats, "x\n" + json.dumps(stats, indent=1)) == (None, None, None)
    assert tokens(one, usage.usage_model_stats, json.dumps(stats, indent=1)) == (4, 2, 5)
    assert tokens(one, usage.usage_table_box, "Execution Summary\n│ Input Tokens │ 12 │") == (12, None, None)
    for parser in (usage.usage_last_json, usage.usage_sum_json, usage.usage_model_stats, usage.usage_table_box):
        for log in ("", "{}", "plain", "{broken", '{"usage": 5}', "[1]"):
            assert tokens(one, parser, log) == (None, None, None)


def test_usage_line_breaks_and_colours(one):
    log = '\x1b[2K{"usage": {"input_tokens": 1}}\u2028{"usage": {"output_tokens": 2}}\x85\x1b[1m{"usage": {}}'
    assert tokens(one, usage.usage_last_json, log) == (None, 2, 2)
    assert tokens(one, usage.usage_sum_json, log) == (1, 2, 3)


def brute_sum(log):
    total, seen = [0, 0], False
    for line in log.splitlines():
        try:
            event = json.loads(line.strip())
        except ValueError:
            continue
        for place in usage.EVENT_PLACES:
            counts = event.get(place)
            if not isinstance(counts, dict):
                continue
            pair = []
            for names in (usage.INPUT_NAMES, usage.OUTPUT_NAMES):
                value = None
                for name in names:
                    value = counts.get(name)
                    if value:
                        break
                pair.append(value)
            if pair != [None, None]:
                seen = True
                total = [t + (p or 0) for t, p in zip(total, pair)]
                break
    return (total[0], total[1], sum(total)) if seen else (None, None, None)


def test_usage_sum_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    names = [*usage.INPUT_NAMES, *usage.OUTPUT_NAMES]
    logs = []
    for _ in range(200):
        lines = []
        for _ in range(rng.randint(0, 5)):
            event = {p: rng.choice([{n: rng.choice([0, 1, 7, None]) for n in rng.sample(names, 2)}, "x", None, {}])
                     for p in rng.sample(usage.EVENT_PLACES, rng.randint(0, 3))}
            lines.append(json.dumps(event) if rng.random() < 0.9 else "{oops")
        logs.append("\n".join(lines))
    df = spark.createDataFrame([(log,) for log in logs], "x string").repartition(4)
    for row in df.select("x", usage.usage_sum_json(F.col("x")).alias("u")).collect():
        assert tuple(row.u) == brute_sum(row.x), row.x


def test_unknown_agent(spark):
    df = spark.createDataFrame([("a", "i", TWO), ("z", "i", TWO)], "agent string, instance_id string, log string")
    parsers = {"a": usage.usage_last_json}
    quiet = usage.token_usage_by_agent(df, parsers, on_unknown="null")
    assert sorted(map(tuple, quiet.collect())) == [("a", "i", 20, 7, 27), ("z", "i", None, None, None)]
    with pytest.raises(Exception, match="no usage parser"):
        usage.token_usage_by_agent(df, parsers).collect()


def brute_lines(log):
    """Status lines of a log by plain string handling."""
    at = log.find(testlogs.SUMMARY)
    found = []
    for n, line in enumerate(log[max(at, 0):].split("\n")):
        line = line.strip()
        for status in testlogs.STATUSES:
            rest = line[len(status):]
            if not line.startswith(status) or not rest[:1].isspace():
                continue
            rest = rest.strip()
            cuts = [i for i in range(1, len(rest) - 2) if rest[i].isspace() and rest[i + 1] == "-" and rest[i + 2].isspace()]
            found.append((n, rest[: cuts[0]].strip() if cuts else rest, status))
    return found


def test_log_lines_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    pieces = [*testlogs.STATUSES, "XFAIL", " ", " ", "  ", "\t", "-", " - ", "a", "t.py::x[1]", "\r", " ", "\n", "\n", testlogs.SUMMARY]
    logs = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(logs)), "n int, log string")
    got = {}
    for row in testlogs.parse_test_log(df).collect():
        got.setdefault(row.n, []).append((row.pos, row.test, row.status))
    for n, log in enumerate(logs):
        assert sorted(got.get(n, [])) == brute_lines(log), repr(log)


def test_result_shapes(spark):
    runs = spark.createDataFrame(
        [("a", "m", "i", ["t1", "t2"], []), ("a", "m", "e", ["t1"], ["t1"])],
        "agent string, model string, instance_id string, expected_f2p_tests array<string>, expected_p2p_tests array<string>")
    passed = spark.createDataFrame(
        [("a", "i", "f2p", "t2"), ("a", "i", "f2p", "other"), ("a", "i", "p2p", "t1"), ("a", "e", "f2p", "t1")],
        "agent string, instance_id string, kind string, test string")
    used = spark.createDataFrame([("a", "i", 1, 2, 3)], "agent string, instance_id string, input bigint, output bigint, total bigint")
    errors = spark.createDataFrame([("a", "e", "boom")], "agent string, instance_id string, error string")
    rows = {r.instance_id: r for r in judging.build_eval_result(runs, passed, used, errors).collect()}
    good, bad = rows["i"], rows["e"]
    assert (good.success_f2p, good.success_p2p, good.success, good.error) == (False, True, False, None)
    assert (good.passed_f2p_tests, good.passed_p2p_tests, good.total_tokens) == (["t2"], [], 3)
    assert (bad.success_f2p, bad.success, bad.passed_f2p_tests, bad.total_tokens, bad.error) == (None, False, None, None, "boom")


def test_pending_and_limit(spark):
    specs = spark.createDataFrame([("r", "a", 2), ("r", "b", 1), ("s", "c", 3)], "repo string, instance_id string, pos int")
    done = spark.createDataFrame([("x", "a"), ("x", "a"), ("gone", "b")], "agent string, instance_id string")
    pending = judging.pending_evaluations(judging.limit_per_repo(specs, 1), done, ["x", "y", "x"])
    assert sorted(map(tuple, pending.collect())) == [("x", "b"), ("x", "c"), ("y", "b"), ("y", "c")]
    first = [r.instance_id for r in judging.shuffle_specs(specs, 1).collect()]
    assert first == [r.instance_id for r in judging.shuffle_specs(specs.repartition(3), 1).collect()]


def test_logs_are_dealt_before_they_are_built(spark):
    from gradewright.plans import evaluation

    found = evaluation.outcomes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(instance_id" in found


def test_status_is_the_first_word(spark):
    assert statuses(spark, "\x1c\u3000 PASSED\u2028a FAILED\n  ERROR PASSED b") == {"a FAILED": "PASSED", "PASSED b": "ERROR"}
