"""Registered queries on the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging
from ..sources import tables
from ..session import scratch_dir
from . import carriers, jobs
from .changes import FLAT, INSTANCE
from .curation import A, B, C, CUST_REPO, MIN_DATE, REPO, VALID, VERSION_KEY
from .evaluation import COMBINED, F2P, FAIL, N, P2P, PASS, PARSERS
from .registry import query

CURATED = f"""valid AS (SELECT * FROM orders WHERE {VALID}),
 best AS (SELECT * FROM (SELECT o_custkey, o_orderkey AS pos, {VERSION_KEY} AS version_key, row_number() OVER (
     PARTITION BY o_custkey ORDER BY {A} DESC, {B} DESC, {C} DESC, o_orderkey) AS rank
   FROM valid WHERE o_orderkey % 6 < 3) WHERE rank <= 3),
 kept AS (SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM valid GROUP BY 1 HAVING count(*) >= 2)
     ON o_custkey = c_custkey
   WHERE (c_custkey % 13 = 0 OR c_mktsegment <> 'MACHINERY') AND c_nationkey > 5
     AND c_custkey IN (SELECT o_custkey FROM best))"""


def curated(spark, sf):
    listing = carriers.table(spark, sf, "customer").selectExpr(
        "concat('o', c_custkey % 7, '/r', c_custkey) AS repo", "'file' AS type",
        "CASE WHEN c_nationkey > 5 THEN 'tests/test_a.py' ELSE 'src/a.py' END AS path")
    return jobs.curate_releases(
        carriers.repos(spark, sf), carriers.releases(spark, sf), listing, min_releases=2, top=3, min_date=MIN_DATE)


@query("curate_repositories", f"""WITH {CURATED} SELECT {CUST_REPO} AS full_name, n AS releases_count FROM kept""")
def _(spark, sf):
    kept, _best = curated(spark, sf)
    return kept.select("full_name", "releases_count")


@query("curate_releases", f"""WITH {CURATED} SELECT 'o' || (o_custkey % 7) || '/r' || o_custkey AS repo, pos, version_key,
  CAST(rank AS INT) AS rank FROM best WHERE o_custkey IN (SELECT c_custkey FROM kept)""")
def _(spark, sf):
    _kept, best = curated(spark, sf)
    return best.select("repo", "pos", "version_key", "rank")


@query("transform_results", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, any_value(repo) AS repo,
  arg_max(version, [k, i, j]) AS version, arg_max(base_commit, [k, i, j]) AS base_commit, 2 AS n_patch, 1 AS n_test
 FROM good GROUP BY 1""")
def _(spark, sf):
    instances, _rejected = jobs.transform_results(carriers.results_document(spark, sf))
    return instances.select("instance_id", "repo", "version", "base_commit", F.size("patch").alias("n_patch"),
                            F.size("test_patch").alias("n_test"))


@query("mine_labels", f"""WITH {COMBINED}, {F2P}, {P2P},
 todo AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 f AS (SELECT instance_id, string_agg(test, ', ' ORDER BY test) AS x FROM f2p GROUP BY 1),
 p AS (SELECT instance_id, string_agg(test, ', ' ORDER BY test) AS y FROM p2p GROUP BY 1)
 SELECT 'i' || o.o_orderkey AS instance_id,
   CASE WHEN t.o_orderkey IS NULL THEN {FAIL.replace('o_orderkey', 'o.o_orderkey')} ELSE x END AS FAIL_TO_PASS,
   CASE WHEN t.o_orderkey IS NULL THEN {PASS.replace('o_orderkey', 'o.o_orderkey')} ELSE y END AS PASS_TO_PASS,
   t.o_orderkey IS NOT NULL OR o.o_orderkey % 3 = 0 OR o.o_orderkey % 4 = 0 AS processed
 FROM orders o LEFT JOIN todo t ON t.o_orderkey = o.o_orderkey LEFT JOIN f ON f.instance_id = 'i' || t.o_orderkey
 LEFT JOIN p ON p.instance_id = 'i' || t.o_orderkey""")
def _(spark, sf):
    specs, _more = jobs.mine_labels(
        carriers.specs(spark, sf), carriers.changed_files(spark, sf), carriers.label_logs(spark, sf))
    return specs.select("instance_id", "FAIL_TO_PASS", "PASS_TO_PASS", "processed")


@query("curated_state", f"""WITH valid AS (SELECT * FROM orders WHERE {VALID}),
 best AS (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (
     PARTITION BY o_custkey ORDER BY {A} DESC, {B} DESC, {C} DESC, o_orderkey) AS rank
   FROM valid WHERE o_orderkey % 6 < 3) WHERE rank <= 3)
 SELECT {REPO} AS repo, n AS releases_count, top FROM (
   SELECT o_custkey, count(*) AS n FROM valid GROUP BY 1 HAVING count(*) >= 2)
 JOIN (SELECT o_custkey, string_agg(o_orderkey, '|' ORDER BY rank) AS top FROM best GROUP BY 1) USING (o_custkey)""")
def _(spark, sf):
    path, releases = scratch_dir(spark, "releases"), carriers.releases(spark, sf)
    for batch, part in ((0, "pos % 3 = 0"), (1, "pos % 3 = 1"), (2, "pos % 3 = 2"), (1, "pos % 3 = 1")):  # one comes twice
        jobs.store_releases(releases.where(part), path, batch, 3, MIN_DATE, buckets=16)
    found = jobs.curated_state(spark, path, 3, 2)
    return found.withColumn("top", F.array_join(F.transform("top", lambda r: (-r["order"]).cast("string")), "|"))


@query("labels_of_statuses", f"""WITH {COMBINED}, {F2P}, {P2P}
 SELECT instance_id, 'f2p' AS kind, test FROM f2p UNION ALL SELECT instance_id, 'p2p', test FROM p2p""")
def _(spark, sf):
    path, logs = scratch_dir(spark, "statuses"), carriers.label_logs(spark, sf, carriers.deal_by_instance(spark, sf))
    for number, part in enumerate(("batch % 3 = 0", "batch % 3 > 0")):  # logs of one test come in both updates
        jobs.store_statuses(logs.where(part), path, number, buckets=16)
    return jobs.labels_of_statuses(spark, path, carriers.changed_selectors(spark, sf))


# Runs of events: t/a.py::f fails for low values, t/c.py::p is skipped in odd events.
RUNS = f"""r AS (SELECT event_type AS agent, 'm' || (user_id % 3) AS model, 'e' || event_id AS instance_id,
   event_type = 'error' AS broken, value > 20 AS f, event_id % 2 = 0 AS p, {N} AS n FROM events)"""


def evaluated(spark, sf):
    events = carriers.table(spark, sf, "events")
    key = ["event_type AS agent", "concat('e', event_id) AS instance_id"]
    runs = events.selectExpr(
        *key, "concat('m', user_id % 3) AS model", "'t/a.py::f, t/b.py::g[x]' AS FAIL_TO_PASS", "'t/c.py::p' AS PASS_TO_PASS")
    logs = events.selectExpr(*key, "0 AS batch", r"""explode(array(
        named_struct('kind', 'f2p', 'log', concat('== short test summary info ==\nPASSED t/a.py::f[1]\n',
          CASE WHEN value > 20 THEN 'PASSED' ELSE 'FAILED' END, ' t/a.py::f[2] - x\nPASSED t/b.py::g[x]\n')),
        named_struct('kind', 'p2p', 'log', concat(CASE WHEN event_id % 2 = 0 THEN 'PASSED' ELSE 'SKIPPED' END,
          ' t/c.py::p\nFAILED t/a.py::f')))) AS l""").select("agent", "instance_id", "batch", "l.*")
    errors = events.where("event_type = 'error'").selectExpr(*key, "'no patch' AS error")
    return jobs.evaluate_runs(runs, logs, carriers.agent_logs(spark, sf), PARSERS, errors, on_unknown="null")


@query("evaluate_runs", f"""WITH {RUNS} SELECT agent, model, instance_id, CASE WHEN NOT broken THEN f END AS success_f2p,
  CASE WHEN NOT broken THEN p END AS success_p2p, NOT broken AND f AND p AS success,
  CASE WHEN NOT broken THEN CASE WHEN f THEN 't/a.py::f|' ELSE '' END || 't/b.py::g[x]' END AS passed_f2p_tests,
  CASE WHEN agent = 'click' OR agent = 'signup' THEN n END AS input_tokens, CASE WHEN broken THEN 'no patch' END AS error FROM r""")
def _(spark, sf):
    return evaluated(spark, sf).select(
        "agent", "model", "instance_id", "success_f2p", "success_p2p", "success",
        F.array_join("passed_f2p_tests", "|").alias("passed_f2p_tests"),
        F.when(F.col("agent").isin("click", "signup"), F.col("input_tokens")).alias("input_tokens"), "error")


@query("evaluate_leaderboard", f"""WITH {RUNS} SELECT agent, model, count(*) AS n,
  avg(CASE WHEN NOT broken AND f AND p THEN 1.0::DOUBLE ELSE 0 END) AS resolved_rate FROM r GROUP BY ROLLUP (agent, model)""")
def _(spark, sf):
    return judging.leaderboard(evaluated(spark, sf)).select("agent", "model", "n", "resolved_rate")


PAIRS = """w AS (SELECT o_orderkey AS k, agent FROM orders, (VALUES ('click'), ('view')) AS v(agent)),
 d AS (SELECT DISTINCT event_type AS agent, user_id AS k FROM events WHERE event_type IN ('click', 'view')),
 p AS (SELECT * FROM w EXCEPT SELECT k, agent FROM d)"""


def scheduled(spark, sf):
    return jobs.schedule_evaluations(
        carriers.specs(spark, sf), carriers.eval_results(spark, sf), ["click", "view", "purchase"], only=["view", "click", "x"])


@query("schedule_evaluations", f"WITH {PAIRS} SELECT agent, 'i' || k AS instance_id FROM p")
def _(spark, sf):
    return scheduled(spark, sf)[0]


@query("scheduled_progress", f"""WITH {PAIRS} SELECT (SELECT count(*) FROM d) AS completed,
  (SELECT count(*) FROM d) + (SELECT count(*) FROM p) AS total""")
def _(spark, sf):
    return scheduled(spark, sf)[1]


@query("save_results", "SELECT event_id, event_type AS agent, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS run_id FROM events")
def _(spark, sf):
    path = scratch_dir(spark, "runs")
    rows = carriers.eval_results(spark, sf)
    tables.save_results(rows.where("agent = 'click'"), path, "a")
    tables.save_results(rows.where("agent <> 'click'"), path, "b")
    results, _keys = tables.load_results(spark, path)
    return results.select("event_id", "agent", "run_id")


@query("compact_keyed", f"SELECT {REPO} AS repo, max(o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    path, target = scratch_dir(spark, "keyed"), scratch_dir(spark, "compact")
    rows = carriers.table(spark, sf, "orders").selectExpr(f"{carriers.ORDER_REPO} AS repo", "o_orderkey AS value")
    tables.append_batch(rows, path, 0)
    tables.compact_keyed(spark, path, target, ["repo"], "value")
    return tables.read_keyed(spark, target, ["repo"], "value")
