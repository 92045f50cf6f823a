"""Filters and rankings over repositories and releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import string_array
from ..functions.text import extract_version, strip, version_key
from .layout import ranged, skew_join

# Accounts that publish generated releases, and topics of repositories to leave out.
BOTS = ("github-actions[bot]", "dependabot[bot]", "renovate[bot]", "greenkeeper[bot]")
EXCLUDED_TOPICS = (
    "tutorial", "beginner", "example", "course", "boilerplate", "book", "awesome", "books",
    "education", "learning", "demo", "starter", "guide",
)
# Fixed value: names of versions before the final one.
PRERELEASE = "(alpha|beta|rc|a[0-9]+|b[0-9]+)"


def not_by_bot(author: Column, bots: Sequence[str] = BOTS) -> Column:
    return ~F.coalesce(author.isin(*bots), F.lit(False))


def has_min_body(body: Column, n: int = 50) -> Column:
    text = F.coalesce(body, F.lit(""))
    # stripping only shortens, so short texts need no pattern
    return (F.length(text) >= n) & (F.length(strip(text)) >= n)


def is_since(published_at: Column, min_date: str = "2024-06-01") -> Column:
    """At or after UTC midnight of ``min_date``; text without a zone or time does not pass."""
    zoned = published_at.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    start = F.lit(f"{min_date}T00:00:00Z").cast("timestamp")
    return F.coalesce(zoned & (F.try_to_timestamp(published_at) >= start), F.lit(False))


def is_valid_release(
    bots: Sequence[str] = BOTS, n: int = 50, min_date: str = "2024-06-01"
) -> Column:
    """Not by a bot, with a substantial body, and recent enough."""
    return (
        not_by_bot(F.col("author.login"), bots)
        & is_since(F.col("published_at"), min_date)
        & has_min_body(F.col("body"), n)
    )


def filter_bot_authors(
    df: DataFrame, bots: Sequence[str] = BOTS, author: str = "author.login"
) -> DataFrame:
    return df.where(not_by_bot(F.col(author), bots))


def filter_min_body(df: DataFrame, col: str = "body", n: int = 50) -> DataFrame:
    return df.where(has_min_body(F.col(col), n))


def filter_min_date(
    df: DataFrame, col: str = "published_at", min_date: str = "2024-06-01"
) -> DataFrame:
    return df.where(is_since(F.col(col), min_date))


def filter_excluded_topics(
    df: DataFrame, topics: Sequence[str] = EXCLUDED_TOPICS, col: str = "topics"
) -> DataFrame:
    overlap = F.arrays_overlap(F.col(col), string_array(topics))
    return df.where(~F.coalesce(overlap, F.lit(False)))


def filter_language_stars(
    df: DataFrame, language: str = "python", min_stars: int = 5000
) -> DataFrame:
    return df.where(
        (F.lower("language") == language.lower()) & (F.col("stargazers_count") >= min_stars)
    )


def valid_release_count(releases: DataFrame, valid: Column | None = None) -> DataFrame:
    """Number of valid releases of every repository, zero included."""
    valid = is_valid_release() if valid is None else valid
    return releases.groupBy("repo").agg(F.count_if(valid).alias("n"))


def filter_min_valid_releases(repos: DataFrame, valid_releases: DataFrame, n: int = 5) -> DataFrame:
    """Repositories with at least ``n`` valid releases, with ``releases_count``."""
    counts = (
        valid_releases.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("releases_count"))
        .where(F.col("releases_count") >= n)
    )
    return repos.join(counts.withColumnRenamed("repo", "full_name"), "full_name")


def exclude_prerelease(df: DataFrame, col: str = "tag_name") -> DataFrame:
    return df.where(~F.lower(col).rlike(PRERELEASE))


def top_releases_per_repo(releases: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` highest final versions of every repository; ties keep input order.

    Spark limits each group before the shuffle, so a hot repository sends ``n`` rows per map task.
    """
    versioned = exclude_prerelease(releases).withColumn("version", extract_version(F.col("tag_name")))
    order = Window.partitionBy("repo").orderBy(F.desc("version"), "pos")
    return (
        versioned.where(F.col("version").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("version_key", version_key(F.col("version")))
    )


def release_state(valid: DataFrame, n: int = 30) -> DataFrame:
    """What of a set of valid releases counts for curation: (repo, releases_count, top), mergeable with that of other sets.

    ``top`` has the ``n`` highest final versions, best first, as (version, order, tag_name); equal versions keep input order.
    """
    best = top_releases_per_repo(valid, n)
    items = F.sort_array(F.collect_list(F.struct("version", (-F.col("pos")).alias("order"), "tag_name")), asc=False)
    tops = best.groupBy("repo").agg(items.alias("top"))
    counts = valid.groupBy("repo").agg(F.count(F.lit(1)).alias("releases_count"))
    return _with_top(counts.join(tops, "repo", "left"), tops)


def _with_top(rows: DataFrame, typed: DataFrame) -> DataFrame:
    none = F.array().cast(typed.schema["top"].dataType)
    return rows.withColumn("top", F.coalesce("top", none)).select("repo", "releases_count", "top")


def merge_release_states(states: DataFrame, n: int = 30) -> DataFrame:
    """One state per repository of those of disjoint sets of releases; equal to the state of all releases at once.

    A repository brings ``n`` releases of each set together, not all it has.
    """
    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, n)
    return states.groupBy("repo").agg(F.sum("releases_count").alias("releases_count"), best.alias("top"))


def require_release(repos: DataFrame, top_releases: DataFrame) -> DataFrame:
    """Repositories that kept at least one release."""
    names = top_releases.select(F.col("repo").alias("full_name")).distinct()
    return repos.join(names, "full_name", "left_semi")


def rank_range(
    df: DataFrame,
    by: str = "stargazers_count",
    tie: str = "full_name",
    start: int = 0,
    end: int = 100,
) -> DataFrame:
    """Rows with 1-based rank in [start, end] by ``by`` descending; ``tie`` should tell equal rows apart.

    Rows are dealt by ranges of the order and stored range by range. The ranges' sizes, one row each, give every range
    the rank of its first row, and only ranges that reach into [start, end] are read again.
    """
    laid = ranged(df, [F.desc(by), F.asc(tie)], "rank-range", by_range=True)
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_size")  # one row per range
    wanted = sizes.withColumn("_before", before).where((F.col("_before") < end) & (F.col("_before") + F.col("_size") >= start))
    placed = laid.join(F.broadcast(wanted.select("_range", "_before")), "_range")
    rank = (F.col("_before") + F.col("_place") + 1).cast("int")
    return placed.withColumn("rank", rank).where(F.col("rank").between(start, end)).select(*df.columns, "rank")


def release_context(releases: DataFrame, repos: DataFrame) -> DataFrame:
    """Releases with the README of their repository ('' if there is none)."""
    readmes = repos.select(F.col("full_name").alias("repo"), "readme")
    joined = skew_join(releases, readmes, ["repo"], "left")
    return joined.withColumn("readme", F.coalesce("readme", F.lit("")))


def skip_cached(
    candidates: DataFrame, cache: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Candidates not yet in the cache, and the cached rows that stand in for the others."""
    keys = list(keys)
    fresh = skew_join(candidates, cache.select(*keys).distinct(), keys, "left_anti")
    cached = skew_join(cache, candidates.select(*keys).distinct(), keys, "left_semi")
    return fresh, cached


def feature_type_counts(release_features: DataFrame) -> DataFrame:
    """New features, improvements and fixes per repository, and overall where ``repo`` is null."""
    kinds = {"new_features": "new_feature", "improvements": "improvement", "bug_fixes": "bug_fix"}
    # counted per repository first: the total expands these rows, not the features
    per_repo = release_features.groupBy("repo").agg(
        *[F.count_if(F.col("feature_type") == kind).alias(name) for name, kind in kinds.items()]
    )
    return per_repo.rollup("repo").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in kinds], F.grouping("repo").alias("is_total")
    )


def results_metadata(features: DataFrame) -> DataFrame:
    """One row: distinct repositories, releases and enhanced features.

    Counts are nested (release, repository, all) so that no distinct aggregate is needed.
    """
    releases = features.groupBy("repo", "tag").agg(F.count(F.lit(1)).alias("features"))
    repos = releases.groupBy("repo").agg(
        F.count(F.lit(1)).alias("releases"), F.sum("features").alias("features")
    )
    return repos.agg(
        F.count(F.lit(1)).alias("total_repositories"),
        F.coalesce(F.sum("releases"), F.lit(0)).alias("total_releases"),
        F.coalesce(F.sum("features"), F.lit(0)).alias("total_enhanced_features"),
    )
