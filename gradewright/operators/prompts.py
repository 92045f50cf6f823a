"""Prompt tables, reply tables, and the features read from replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..functions.text import (
    build_pr_links, extract_pr_number, pr_references, render_template, truncate_readme,
)
from ..schemas import FEATURE_REPLY
from .layout import heavy_keys, skew_join

# Own short defaults; pass the templates of a project for its real prompts.
RELEASE_TEMPLATE = "{readme_context}Sort the changes of release {tag_name}.\n{release_body}"
PR_TEMPLATE = "Feature: {feature_description}\nTitle: {pr_title}\n{pr_body}\n{files_text}"
FEATURE_TEMPLATE = "{feature_type}: {feature_description}\n{prs_text}"


def render_release_prompt(df: DataFrame, template: str = RELEASE_TEMPLATE) -> DataFrame:
    """(prompt_key, prompt) of releases with columns repo, tag_name, body and readme."""
    slots = {
        "readme_context": truncate_readme(F.col("readme")),
        "tag_name": F.col("tag_name"),
        "release_body": F.col("body"),
    }
    key = F.concat_ws("#", "repo", "tag_name")
    return df.select(key.alias("prompt_key"), render_template(template, slots).alias("prompt"))


def summarise_file_changes(
    changes: Column, max_files: int | None = None, max_patch: int | None = None, preview: int | None = None
) -> Column:
    """Text summary of the non-test file changes of an array: all of them and whole patches, unless bounds are given."""
    others = F.filter(changes, lambda c: ~is_test_path(c["filename"]))

    def line(c: Column) -> Column:
        head = F.concat(
            F.lit("- "), c["filename"], F.lit(" ("), c["status"], F.lit("): +"),
            c["additions"].cast("string"), F.lit("/-"), c["deletions"].cast("string"),
        )
        size = F.length(F.coalesce(c["patch"], F.lit("")))
        patch = c["patch"] if preview is None else F.substring(c["patch"], 1, preview)
        shown = F.concat(F.lit("\n  "), patch, F.lit("..."))
        short = (size > 0) if max_patch is None else (size > 0) & (size < max_patch)
        return F.concat(head, F.when(short, shown).otherwise(""))

    listed = others if max_files is None else F.slice(others, 1, max_files)
    text = F.array_join(F.transform(listed, line), "\n")
    if max_files is not None:
        rest = (F.size(others) - max_files).cast("string")
        more = F.concat(F.lit("\n... and "), rest, F.lit(" more files"))
        text = F.concat(text, F.when(F.size(others) > max_files, more).otherwise(""))
    return F.when(F.size(others) > 0, text).otherwise("No files were modified in this PR.")


def render_pr_prompt(df: DataFrame, template: str = PR_TEMPLATE) -> DataFrame:
    """(prompt_key, prompt) of pull requests with their feature and an array of file changes."""
    slots = {
        "feature_description": F.col("feature_description"),
        "pr_title": F.col("title"),
        "pr_body": F.col("body"),
        "files_text": summarise_file_changes(F.col("file_changes")),
    }
    key = F.concat_ws("#", "repo", "pr_number")
    return df.select(key.alias("prompt_key"), render_template(template, slots).alias("prompt"))


def pr_block(prs: Column) -> Column:
    """Text block of an ordered array of pull request summaries."""

    def one(p: Column) -> Column:
        return F.concat(
            F.lit("\nPR #"), p["pr_number"], F.lit(": "), p["title"], F.lit("\n- Status: "),
            p["state"], F.lit(" (merged: "), F.initcap(p["merged"].cast("string")),
            F.lit(")\n- Files changed: "), p["files"].cast("string"),
            F.lit("\n- User benefits: "), p["detailed_description"], F.lit("\n"),
        )

    return F.array_join(F.transform(prs, one), "\n")


def with_prs(features: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Features with ``prs``, the known pull requests that their links name, in the order of the links.

    ``pull_requests`` has (repo, pr_number) and the fields of :func:`pr_block`, one row each. A feature's array is at most
    as long as its own list of links; features without any known one are left out.
    """
    key = ["repo", "tag", "feature_type", "pos"]
    links = features.select(*key, F.posexplode("pr_links").alias("link_pos", "_link")).withColumn("pr_number", extract_pr_number(F.col("_link")))
    found = skew_join(links.drop("_link"), pull_requests, ["repo", "pr_number"], "inner", sorted_merge=True)
    fields = F.struct("link_pos", "pr_number", "title", "state", "merged", "files", "detailed_description")
    blocks = found.groupBy(*key).agg(F.array_sort(F.collect_list(fields)).alias("prs"))
    return features.join(blocks.hint("merge"), key)


def render_feature_prompt(df: DataFrame, template: str = FEATURE_TEMPLATE) -> DataFrame:
    """(prompt_key, prompt) of features whose ``prs`` array has the analysed pull requests."""
    slots = {
        "feature_type": F.col("feature_type"),
        "feature_description": F.col("description"),
        "prs_text": pr_block(F.col("prs")),
    }
    key = F.concat_ws("#", "repo", "tag", "feature_type", F.col("pos").cast("string"))
    return df.select(key.alias("prompt_key"), render_template(template, slots).alias("prompt"))


def extract_pr_refs(df: DataFrame, col: str = "body") -> DataFrame:
    """One row per pull request mentioned in a text, in order of first mention."""
    return df.select("*", F.posexplode(pr_references(F.col(col))).alias("ref_pos", "pr_id"))


# Lists of a reply and the feature type of their items.
REPLY_LISTS = {
    "new_features": "new_feature",
    "improvements": "improvement",
    "bug_fixes": "bug_fix",
    "other_changes": "other",
}


def parse_feature_json(
    responses: DataFrame, host: str = "https://github.com"
) -> tuple[DataFrame, DataFrame]:
    """Features of (prompt_key 'repo#tag', text) replies, and the replies that are not JSON.

    Text around the outer braces is ignored; an empty reply has no features.
    """
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    parsed = responses.withColumn(
        "_reply",
        F.from_json(body, FEATURE_REPLY, {"columnNameOfCorruptRecord": "_corrupt_record"}),
    )
    is_empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    broken = ~is_empty & ((body == "") | F.col("_reply._corrupt_record").isNotNull())
    key = F.split("prompt_key", "#", 2)
    good = parsed.where(~broken & ~is_empty).select(
        F.get(key, F.lit(0)).alias("repo"), F.get(key, F.lit(1)).alias("tag"), "_reply"
    )
    lists = F.array(*[
        F.struct(F.lit(kind).alias("feature_type"), F.col(f"_reply.{name}").alias("items"))
        for name, kind in REPLY_LISTS.items()
    ])
    long = good.select("repo", "tag", F.explode(lists).alias("_l")).select(
        "repo", "tag", F.col("_l.feature_type").alias("feature_type"),
        F.posexplode("_l.items").alias("pos", "_item"),
    )
    ids = F.coalesce("_item.pr_ids", F.array().cast("array<string>"))
    features = long.select(
        "repo", "tag", "feature_type", "pos",
        F.coalesce("_item.description", F.lit("")).alias("description"),
        build_pr_links(F.col("repo"), ids, host).alias("pr_links"),
    )
    return features, parsed.where(broken).select("prompt_key", "text")


def filter_new_features_with_prs(release_features: DataFrame) -> DataFrame:
    return release_features.where("feature_type = 'new_feature' AND size(pr_links) > 0")


def attach_responses(
    prompts: DataFrame, responses: DataFrame, fallback: str | None = None
) -> DataFrame:
    """Replies by prompt key; a missing one falls back to the column ``fallback``."""
    joined = prompts.join(
        responses.select("prompt_key", F.col("text").alias("response")), "prompt_key", "left"
    )
    if fallback is None:
        return joined
    return joined.withColumn("response", F.coalesce("response", fallback))


def enhance_features(
    features: DataFrame, pr_analyses: DataFrame, responses: DataFrame
) -> DataFrame:
    """Features that have analysed pull requests, with their detailed description.

    One pull request lends its own description, several need a reply for the feature (joined on
    repo, tag, feature_type, pos); a feature without either is dropped. The pull requests are
    gathered per feature, at most as many as the feature's own list of links.
    """
    key = ["repo", "tag", "feature_type", "pos"]
    links = features.select(*key, F.posexplode("pr_links").alias("link_pos", "_link")).withColumn(
        "pr_number", extract_pr_number(F.col("_link"))
    )
    texts = pr_analyses.select("repo", "pr_number", "detailed_description")
    analysed = skew_join(links, texts, ["repo", "pr_number"], "inner", sorted_merge=True)
    per_feature = analysed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_prs"),
        F.min_by("detailed_description", "link_pos").alias("_first"),
        F.array_sort(F.collect_list(F.struct("link_pos", "pr_number"))).alias("_prs"),
    )
    joined = (
        features.join(per_feature.hint("merge"), key)
        .join(responses.select(*key, F.col("text").alias("_reply")).hint("merge"), key, "left")
        .withColumn(
            "feature_detailed_description",
            F.when(F.col("n_prs") == 1, F.col("_first")).otherwise(F.col("_reply")),
        )
        .where(F.coalesce("feature_detailed_description", F.lit("")) != "")
    )
    return joined.select(
        *features.columns, "n_prs",
        F.transform("_prs", lambda p: p["pr_number"]).alias("pr_numbers"),
        "feature_detailed_description",
    )


def commits_with_default(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Base and head commit of every pull request; an unknown one keeps its sha, the rest ''."""
    out = prs
    for side in ("base", "head"):
        known = commits.select(
            "repo",
            F.col("sha").alias(f"{side}_sha"),
            F.struct("sha", "message", "date", "author").alias("_commit"),
        )
        on = ["repo", f"{side}_sha"]
        # hot keys are counted on the input, not on what the join before gave
        joined = skew_join(out, known, on, "left", heavy=heavy_keys(prs, on))
        blank = F.lit("")
        default = F.struct(
            F.col(f"{side}_sha").alias("sha"), blank.alias("message"), blank.alias("date"),
            blank.alias("author"),
        )
        out = joined.withColumn(f"{side}_commit", F.coalesce("_commit", default)).drop("_commit")
    return out
