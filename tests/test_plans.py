"""Physical plans: what must and must not be in them."""

import re

import pytest

from gradewright.plans import QUERIES

SF = "/root/testdata/sf0.001"
# Queries that read Python syntax; the only ones that may leave the JVM.
SYNTAX = {
    "extract_definitions", "parse_code_elements", "diff_definitions", "only_modified",
    "diff_code_elements", "modified_elements", "filter_pytest_changes", "build_test_selectors",
    "skip_unchanged_specs", "gate_pr",
}
# Queries that hand chains of patches, each on what the one before it left, through a task in order.
CHAINS = {"apply_hunks", "apply_hunks_status", "patch_application_summary", "applied_files", "apply_patch_chains", "apply_patch_chains_status"}
# The job that reads Python syntax into a table before it builds its plan.
STORED = {"mine_labels"}
# Queries that run streams or write files when they are built.
EAGER = {
    "read_results_document", "read_results_blocks", "read_patch_records", "read_instances_json", "read_instances_published", "write_published_split",
    "read_crawl_list", "read_keyed_cache", "read_patch_files", "write_instances", "write_final_results",
    "read_keyed", "compact_keyed", "save_results", "load_results", "store_test_logs", "stream_upsert_keyed", "stream_new_releases",
    "stream_eval_progress", "upsert_buckets", "stream_upsert_buckets", "stream_eval_results", "labels_of_statuses", "curated_state",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - STORED))
def test_no_cross_joins_and_no_stray_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    python = any(node in text for node in ("MapInArrow", "InPandas", "EvalPython"))
    assert python == (name in SYNTAX | CHAINS)


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["filter_pending_specs"](spark, SF).where("pos > 5"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_group_limits_come_before_the_shuffle(spark):
    for name in ("top_releases_per_repo", "limit_per_repo"):
        text = plan(QUERIES[name](spark, SF))
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_labels_read_the_logs_once(spark):
    df = QUERIES["derive_labels"](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("lineitem.parquet") == 1 and "ReusedExchange" in text


def test_mining_reads_its_tables_once_or_twice(spark):
    text = plan(QUERIES["mine_labels"](spark, SF))
    assert text.count("FileScan") <= 7 and text.count("lineitem.parquet") <= 2
    assert len(re.findall("Exchange hashpartitioning", text)) <= 12


@pytest.mark.parametrize("name", [
    "dedup_keep_last", "last_per_key", "pick_readme", "upsert_keyed_cache", "leaderboard", "feature_type_counts", "transform_results",
    "gate_pr", "diff_code_elements", "modified_elements", "file_membership", "commits_with_default",
])
def test_rows_are_not_sorted_in_aggregates(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SF))


def test_totals_expand_counts(spark):
    for name in ("leaderboard", "feature_type_counts"):
        text = plan(QUERIES[name](spark, SF))
        assert text.index("Expand") < text.rindex("HashAggregate") and text.index("Expand") < text.index("FileScan")
        assert "HashAggregate" in text[text.index("Expand") :]


def test_statuses_use_hash_aggregation(spark):
    text = plan(QUERIES["aggregate_param_status"](spark, SF))
    assert "SortAggregate" not in text and "partial_max_by" in text


def test_exploded_sides_are_not_broadcast(spark):
    for name, joins in (("render_feature_prompt", 2), ("enhance_features", 3)):
        assert plan(QUERIES[name](spark, SF)).count("SortMergeJoin") == joins


def test_label_lines_are_not_shuffled(spark):
    text = plan(QUERIES["derive_labels"](spark, SF))
    for exchange in re.findall(r".*Exchange hashpartitioning.*\n.*\n", text):  # line items, orders and what may give a label
        assert "max_by" not in exchange and "posexplode" not in exchange
    assert "posexplode" not in plan(QUERIES["judge_expected_tests"](spark, SF))  # the labels are stored
    assert "Join" not in plan(QUERIES["parse_log_lines"](spark, SF))


def test_selectors_and_outcomes_are_not_shuffled(spark):
    for name in ("resolve_test_status", "query_tests"):
        text = plan(QUERIES[name](spark, SF))
        exchanges = re.findall(r".*Exchange hashpartitioning.*\n.*\n", text)
        assert len(exchanges) == 2 and "Join" not in text  # line items, for the logs and for the selectors
        assert all("FileScan" in e or "Project" in e for e in exchanges) and "posexplode" not in "".join(exchanges)
