"""From the mined results document to one benchmark instance per pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_instance_id, number, org
from ..schemas import FILE_CHANGES, INSTANCE_COLUMNS
from .layout import last_per_key, nest_in_chunks, skew_join

POSITION = ["entry_pos", "feature_pos", "pr_pos"]


def flatten_results(results: DataFrame) -> DataFrame:
    """One row per (entry, feature, pull request); the three positions give the input order.

    ``results`` has (pos, repository, release, enhanced_new_features).
    """
    features = results.select(
        F.col("pos").alias("entry_pos"),
        F.col("repository").alias("repo"),
        F.col("release").alias("version"),
        F.posexplode("enhanced_new_features").alias("feature_pos", "_feature"),
    )
    prs = features.select(
        "entry_pos", "feature_pos", "repo", "version",
        F.col("_feature.description").alias("feature_description"),
        F.posexplode("_feature.pr_analyses").alias("pr_pos", "_pr"),
    )
    return prs.select(
        *POSITION, "repo", "version", "feature_description",
        F.col("_pr.pr_number").alias("pr_number"),
        F.col("_pr.base_commit.sha").alias("base_commit"),
        F.col("_pr.base_commit.date").alias("created_at"),
        F.col("_pr.detailed_description").alias("problem_statement"),
        F.col("_pr.file_changes").alias("file_changes"),
        F.col("_pr.test_files").alias("test_files"),
    )


def drop_incomplete_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with repository, number and base commit, and the others with the reason."""

    def blank(name: str):
        return F.coalesce(F.col(name), F.lit("")) == ""

    reason = (
        F.when(blank("repo"), "no repository")
        .when(blank("pr_number"), "no pull request number")
        .when(blank("base_commit"), "no base commit")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def split_file_changes(df: DataFrame) -> DataFrame:
    """Test changes (file named in ``test_files``) and source changes (all others) as two arrays."""
    changes = F.coalesce("file_changes", F.array().cast(FILE_CHANGES))
    tests = F.coalesce("test_files", F.array().cast("array<string>"))

    def named(change):
        return F.coalesce(F.array_contains(tests, change["filename"]), F.lit(False))

    return df.withColumns({
        "patch": F.filter(changes, lambda c: ~named(c)),
        "test_patch": F.filter(changes, named),
    })


def build_instances(flat: DataFrame) -> DataFrame:
    """Instance rows of complete flattened rows, with ``pos`` for keep-last deduplication."""
    repo, pr = F.col("repo"), F.col("pr_number")
    rows = split_file_changes(flat).withColumns({
        "pos": F.struct(*POSITION),
        "instance_id": make_instance_id(repo, pr),
        "org": org(repo),
        "number": number(pr),
        "problem_statement": F.coalesce("problem_statement", F.lit("")),
        "created_at": F.coalesce("created_at", F.lit("")),
        "version": F.coalesce("version", F.lit("")),
        "test_files": F.coalesce("test_files", F.array().cast("array<string>")),
        "hints_text": F.lit(""),
        "PASS_TO_PASS": F.lit(""),
        "FAIL_TO_PASS": F.lit(""),
    })
    return rows.select(*INSTANCE_COLUMNS, "pos")


def dedup_keep_last(df: DataFrame, key: str = "instance_id", pos: str = "pos") -> DataFrame:
    """The last row of every key, at the position of the first.

    Both are cut to one row per key and task before their shuffle; the first carries its position only.
    """
    first = Window.partitionBy(key).orderBy(pos)
    places = df.select(key, pos).withColumn("_place", F.row_number().over(first)).where("_place = 1")
    rows = last_per_key(df, [key], [pos]).drop(pos).withColumnRenamed(key, "_key")
    same = F.col("_key").eqNullSafe(F.col(key))
    return rows.join(places.drop("_place"), same).drop("_key").select(*df.columns)


def derive_spec(instances: DataFrame) -> DataFrame:
    """Run-time form of an instance: short repository name, number as text, ``processed`` set."""
    processed = (
        F.coalesce("processed", F.lit(False)) if "processed" in instances.columns else F.lit(False)
    )
    return instances.withColumns({
        "repo_name": F.substring_index("repo", "/", -1),
        "number": F.col("number").cast("string"),
        "processed": processed,
    })


def file_membership(
    file_changes: DataFrame, test_files: DataFrame, keys: tuple[str, ...] = ("instance_id",)
) -> tuple[DataFrame, DataFrame]:
    """Test and source rows of a long table of file changes; a null name is a source row."""
    on = [*keys, "filename"]
    names = test_files.select(*on).distinct().withColumn("_named", F.lit(True))
    marked = skew_join(file_changes, names, on, "left").select(*file_changes.columns, "_named")
    return marked.where("_named").drop("_named"), marked.where("_named IS NULL").drop("_named")


def nest_release_results(features: DataFrame, analyses: DataFrame, size: int = 10_000) -> DataFrame:
    """Enhanced features as one array per release, with the analysis they came from.

    Arrays are cut every ``size`` features (``chunk`` 0, 1, ...), so one release cannot outgrow a task.
    """
    value = F.struct("feature_type", "description", "feature_detailed_description")
    nested = nest_in_chunks(features, ["repo", "tag"], "pos", value, "enhanced_new_features", size)
    return nested.join(analyses, ["repo", "tag"], "left")


def drop_releases_without_features(releases: DataFrame, features: DataFrame) -> DataFrame:
    kept = features.select("repo", "tag").distinct()
    return releases.join(kept, ["repo", "tag"], "left_semi")


def preview_results(df: DataFrame, n: int = 5, m: int = 2) -> DataFrame:
    """First ``m`` features of the first ``n`` results, texts shortened for reading."""
    first = df.orderBy("pos").limit(n)
    features = first.select(
        "pos", "repository", "release",
        F.posexplode(F.slice("enhanced_new_features", 1, m)).alias("feature_pos", "_f"),
    )
    return features.select(
        "pos", "repository", "release", "feature_pos",
        F.concat(F.substring("_f.description", 1, 100), F.lit("...")).alias("description"),
        F.size("_f.pr_analyses").alias("pr_count"),
        F.concat(F.substring("_f.feature_detailed_description", 1, 150), F.lit("..."))
        .alias("detailed_description"),
    )
