"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores
(default 8). Names given as arguments replace the headline list; 'all' runs every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradewright.plans import QUERIES  # noqa: E402
from gradewright.session import local_session  # noqa: E402

HEADLINE = [
    "is_valid_release",
    "top_releases_per_repo",
    "feature_type_counts",
    "parse_test_log",
    "aggregate_param_status",
    "resolve_test_status",
    "derive_labels",
    "judge_expected_tests",
    "leaderboard",
    "pending_evaluations",
    "token_usage_by_agent",
    "parse_unified_diff",
    "apply_hunks",
    "dedup_keep_last",
    "gate_pr",
    "diff_code_elements",
    "enhance_features",
    "transform_results",
    "mine_labels",
    "evaluate_runs",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if asked == ["all"] else asked
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16)
    seconds(spark, "leaderboard", sf_dir)  # starts the JVM's compilers and the page cache
    times = {}
    for name in names:
        times[name] = seconds(spark, name, sf_dir)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
