"""The four jobs that a user runs end to end, composed of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_test_list
from ..operators import curation, judging, labels, repos, symbols, testlogs, transform, usage
from ..operators.layout import dealing, skew_join
from ..session import scratch_dir
from ..sources import keyed


def curate_releases(
    candidates: DataFrame,
    releases: DataFrame,
    repo_tree: DataFrame,
    min_releases: int = 5,
    top: int = 30,
    min_date: str = "2024-06-01",
    topics: Sequence[str] = curation.EXCLUDED_TOPICS,
) -> tuple[DataFrame, DataFrame]:
    """Repositories worth mining with their number of valid releases, and their top releases.

    Listings are aggregated once, for all repositories.
    """
    wanted = curation.filter_excluded_topics(candidates, topics)
    valid = releases.where(curation.is_valid_release(min_date=min_date))
    counted = curation.filter_min_valid_releases(wanted, valid, min_releases)
    tested = repos.has_test_suite(repo_tree).where("has_tests").select(F.col("repo").alias("full_name"))
    suited = counted.join(tested, "full_name", "left_semi")
    best = curation.top_releases_per_repo(valid, top)
    kept = curation.require_release(suited, best)
    names = kept.select(F.col("full_name").alias("repo"))
    return kept, best.join(names, "repo", "left_semi")


def transform_results(results: DataFrame, deduplicate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Instances of a results document, and the pull requests left out with the reason."""
    complete, rejected = transform.drop_incomplete_entries(transform.flatten_results(results))
    instances = transform.build_instances(complete)
    return (transform.dedup_keep_last(instances) if deduplicate else instances), rejected


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read again, for what a job uses more than once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mine_labels(
    specs: DataFrame, test_files: DataFrame, logs: DataFrame, per_repo: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Specs with the labels that their stored logs show, and the further chunks of labels too many for one text.

    ``test_files`` has (instance_id, path, before, after): the texts of test files around the test patch. ``logs``
    has (instance_id, kind, phase, batch, log), where ``batch`` orders the logs of an instance, kind and phase. Specs
    whose tests did not change are marked processed and keep their labels; changed ones with logs get labels, null
    where there are none, and are processed; changed ones without logs wait. ``per_repo`` limits the specs of a
    repository that are looked at; by default all are.
    """
    listed = specs if per_repo is None else judging.limit_per_repo(specs, per_repo)
    pending = labels.filter_pending_specs(listed).select("instance_id")
    code = skew_join(test_files, pending, ["instance_id"], "left_semi")
    keys = ["instance_id", "path"]
    sides = [
        symbols.parse_code_elements(code.select(*keys, F.col(side).alias("content"))).drop("content")
        for side in ("before", "after")
    ]
    changes = _stored(symbols.filter_pytest_changes(symbols.diff_code_elements(*sides)), "label-changes")
    selectors = testlogs.build_test_selectors(changes).select("instance_id", "selector")
    marked = _stored(labels.mark_changed(pending, changes), "label-specs")
    changed = marked.where("changed").select("instance_id")
    own = skew_join(logs, changed, ["instance_id"], "left_semi")
    lines = testlogs.parse_test_log(own)
    lines = lines.withColumn("pos", testlogs.log_order(F.col("batch"), F.col("pos"))).drop("batch")
    long = _stored(labels.derive_labels(selectors, lines), "labels")
    texts = _stored(labels.label_strings(long), "label-texts")
    logged = changed.join(logs.select("instance_id").distinct(), "instance_id", "left_semi")
    found = logged.join(texts.where("chunk = 0"), "instance_id", "left")
    new = labels.update_labels(specs, found)
    skipped = marked.where("NOT changed").select("instance_id", F.lit(True).alias("_skipped"))
    done = F.col("processed") | F.col("_skipped").isNotNull()
    new = new.join(skipped, "instance_id", "left").withColumn("processed", done).select(*specs.columns)
    return new, texts.where("chunk > 0")


STATUS_KEYS = ["instance_id", "kind", "phase", "test"]
STATUS_BY = ["instance_id", "test"]  # so that the statuses of one test lie together


def store_statuses(logs: DataFrame, path: str, batch: int = 0, buckets: int = keyed.BUCKETS) -> None:
    """Reduce new logs to the last status of every test and merge these into the table at ``path``.

    ``logs`` as for :func:`mine_labels`; the logs' own ``batch`` orders them whenever they come, ``batch`` here numbers
    the update. Logs that were stored before are not read again.
    """
    lines = testlogs.parse_test_log(logs)
    lines = lines.withColumn("pos", testlogs.log_order(F.col("batch"), F.col("pos"))).drop("batch")
    # told apart by their order alone, so an update that is repeated or late changes nothing
    last = testlogs.last_lines(lines, STATUS_KEYS)
    keyed.upsert_buckets(last, path, STATUS_KEYS, "pos", batch, by_batch=False, buckets=buckets, unique=True, by=STATUS_BY)


def labels_of_statuses(spark: SparkSession, path: str, selectors: DataFrame) -> DataFrame:
    """Both kinds of labels from the stored statuses: those of all logs at once, without reading any.

    Statuses and selectors are dealt by instance alike, as they lie; where an instance is hot, the aggregates deal them.
    """
    statuses = keyed.read_buckets(spark, path)
    deal = dealing(statuses, ["instance_id"], rows=1_000_000)
    if len(deal) > 1:
        statuses, selectors = statuses.repartition(*deal), selectors.repartition(*deal)
    return labels.derive_labels(selectors, statuses)


def store_releases(releases: DataFrame, path: str, batch: int, top: int = 30, min_date: str = "2024-06-01", buckets: int = keyed.BUCKETS) -> None:
    """Keep what newly crawled releases add to their repositories' curation; a batch that comes again replaces itself."""
    valid = releases.where(curation.is_valid_release(min_date=min_date))
    state = curation.release_state(valid, top).withColumn("part", F.lit(batch))
    keyed.upsert_buckets(state, path, ["repo", "part"], None, batch, buckets=buckets)


def curated_state(spark: SparkSession, path: str, top: int = 30, min_releases: int = 5) -> DataFrame:
    """(repo, releases_count, top) of repositories with enough valid releases and one to use, over all stored batches."""
    merged = curation.merge_release_states(keyed.read_buckets(spark, path), top)
    return merged.where((F.col("releases_count") >= min_releases) & (F.size("top") > 0))


def schedule_evaluations(
    specs: DataFrame,
    results: DataFrame,
    agents: Sequence[str],
    only: Sequence[str] | None = None,
    per_repo: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The (agent, instance) pairs still to run, and one row of how many of the chosen agents' pairs are done.

    ``only`` chooses among the configured agents, ``per_repo`` limits the specs of a repository (all by default);
    ``results`` are stored runs, of which those of chosen agents count.
    """
    chosen = [a for a in dict.fromkeys(agents) if only is None or a in only]
    listed = specs if per_repo is None else judging.limit_per_repo(specs, per_repo)
    done = judging.select_agents(results, chosen).select("agent", "instance_id").distinct()
    pending = judging.pending_evaluations(listed, done, chosen)
    return pending, judging.evaluation_progress(pending, done)


def evaluate_runs(
    runs: DataFrame,
    test_logs: DataFrame,
    agent_logs: DataFrame,
    parsers: Mapping[str, usage.Parser],
    errors: DataFrame,
    on_unknown: str = "error",
) -> DataFrame:
    """Result rows of (agent, model, instance_id, FAIL_TO_PASS, PASS_TO_PASS) runs.

    ``test_logs`` has (agent, instance_id, kind, batch, log) for the kinds 'f2p' and 'p2p'; ``batch`` orders the logs
    of a run and kind. An agent without a parser is an error unless ``on_unknown`` is 'null'.
    """
    keys = ["agent", "instance_id", "kind"]
    expected = runs.select(
        "agent", "model", "instance_id",
        decode_test_list(F.col("FAIL_TO_PASS")).alias("expected_f2p_tests"),
        decode_test_list(F.col("PASS_TO_PASS")).alias("expected_p2p_tests"),
    )
    lists = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"expected_{kind}_tests").alias("tests"))
        for kind in ("f2p", "p2p")
    ])
    selectors = (
        expected.select("agent", "instance_id", F.explode(lists).alias("_l"))
        .select("agent", "instance_id", "_l.kind", F.explode("_l.tests").alias("selector"))
        .distinct()
    )
    lines = testlogs.parse_test_log(test_logs)
    lines = lines.withColumn("pos", testlogs.log_order(F.col("batch"), F.col("pos")))
    outcomes = testlogs.last_status_per_test(lines, keys)
    passed = testlogs.query_tests(selectors, outcomes, ("PASSED",), keys)
    tokens = usage.token_usage_by_agent(agent_logs, parsers, on_unknown)
    return judging.build_eval_result(
        expected, passed.withColumnRenamed("selector", "test"), tokens, errors
    )
