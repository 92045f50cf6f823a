"""What a repository's file listing says about it: suites, README, CI files, set-up data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import (
    SUITE_DIRS, SUITE_IGNORED, TEST_DIRS, TEST_FILES, file_name, matches_any_start,
)
from ..functions.text import image_name
from .layout import heavy_keys, skew_join


def has_test_suite(
    repo_tree: DataFrame,
    dirs: Sequence[str] = TEST_DIRS,
    patterns: Sequence[str] = TEST_FILES,
) -> DataFrame:
    """Per repository: a root test file, or a Python file under a root folder named after tests."""
    path = F.col("path")
    name = file_name(path)
    root = F.substring_index(path, "/", 1)
    is_root = ~path.contains("/")
    test_file = matches_any_start(name, patterns)
    test_root = F.lower(root).rlike("|".join(dirs))
    hit = (F.col("type") == "file") & (
        (is_root & test_file) | (~is_root & test_root & (name.endswith(".py") | test_file))
    )
    return repo_tree.groupBy("repo").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("has_tests"))


def detect_test_dirs(
    repo_tree: DataFrame,
    candidates: Sequence[str] = SUITE_DIRS,
    ignore: Sequence[str] = SUITE_IGNORED,
    default: str = "tests",
) -> DataFrame:
    """Suite folders of every repository, one row each: those at the root, else at any depth
    outside the ignored root folders, else the default. Array form: ``nest_in_chunks``."""
    parts = F.split("path", "/")
    depth = F.when(F.col("type") == "dir", F.size(parts)).otherwise(F.size(parts) - 1)
    folders = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    suites = F.filter(folders, lambda d: file_name(d).isin(*candidates))
    dirs = repo_tree.select("repo", F.explode_outer(suites).alias("dir")).distinct()
    at_root = F.coalesce(~F.col("dir").contains("/"), F.lit(False))
    nested = F.col("dir").contains("/") & ~F.substring_index("dir", "/", 1).isin(*ignore)
    nested = F.coalesce(nested, F.lit(False))
    repos = dirs.groupBy("repo").agg(
        F.bool_or(at_root).alias("_at_root"),
        F.bool_or(nested).alias("_nested"),
        F.count(F.lit(1)).alias("n"),
    )
    known = skew_join(
        dirs.where(at_root | nested), repos.select("repo", "_at_root"), ["repo"], "inner",
        heavy=heavy_keys(repos, ["repo"], rows=F.col("n")),
    ).where(at_root | ~F.col("_at_root"))
    bare = repos.where("NOT _at_root AND NOT _nested").select("repo", F.lit(default).alias("test_dir"))
    return known.select(
        "repo", F.regexp_replace("dir", r"^[./]+", "").alias("test_dir")
    ).unionByName(bare)


def pick_readme(repo_tree: DataFrame) -> DataFrame:
    """Content of the first root README of every repository in listing order, else ''."""
    is_readme = (
        (F.col("type") == "file")
        & F.lower("path").rlike(r"^readme(?:\.md|\.rst|\.txt)?$")
        & F.col("content").isNotNull()
    )
    # README rows are few: only they are ordered, and their contents never enter an aggregate
    order = Window.partitionBy("repo").orderBy("pos")
    readmes = repo_tree.where(is_readme).select("repo", "pos", "content")
    first = readmes.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    named = first.select(F.col("repo").alias("_repo"), F.col("content").alias("readme"))
    repos = repo_tree.select("repo").distinct()
    return repos.join(named, F.col("repo").eqNullSafe(F.col("_repo")), "left").select(
        "repo", F.coalesce("readme", F.lit("")).alias("readme")
    )


def ci_files(repo_tree: DataFrame) -> DataFrame:
    """Workflow files that can be downloaded, one row per file."""
    return repo_tree.where(
        (F.col("type") == "file")
        & F.col("path").rlike(r"^\.github/workflows/[^/]*\.ya?ml$")
        & (F.coalesce("download_url", F.lit("")) != "")
    ).select("repo", "path", "pos", "download_url")


def collect_ci_configs(repo_tree: DataFrame, size: int = 10_000) -> DataFrame:
    """Map of workflow path to address per repository, in chunks of ``size`` listing positions."""
    entry = F.struct("path", "download_url")
    # a path listed twice keeps its last address
    last = ci_files(repo_tree).groupBy("repo", "path").agg(
        F.max_by("download_url", "pos").alias("download_url"), F.max("pos").alias("pos")
    )
    return (
        last.groupBy("repo", F.floor(F.col("pos") / size).alias("chunk"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("ci_configs"))
    )


def repo_dimension_lookup(
    df: DataFrame, dim: DataFrame, value: str, default: Column | None = None, repo: str = "repo"
) -> DataFrame:
    """Value of a two-column dimension ``(repo_key, value)`` under the flat name of the repository."""
    keyed = df.withColumn("repo_key", F.replace(F.col(repo), F.lit("/"), F.lit("_")))
    joined = skew_join(keyed, dim.select("repo_key", value), ["repo_key"], "left").drop("repo_key")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, default))


def distinct_images(instances: DataFrame, prefix: str = "registry.local/bench") -> DataFrame:
    """Sorted image names that the instances need."""
    name = image_name(F.col("repo"), F.col("number"), F.col("docker_image"), prefix)
    return instances.select(name.alias("image")).where("image IS NOT NULL").distinct().orderBy("image")
