"""Rows from landed API payloads: one row per response, its JSON text in ``payload``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COMMIT_PAYLOAD, PR_FILE_PAYLOAD, PR_PAYLOAD, RELEASE_PAYLOAD, REPO_PAYLOAD

BAD = "_corrupt_record"


def _is_read() -> Column:
    return F.col("_p").isNotNull() & F.col(f"_p.{BAD}").isNull()


def _parse(landing: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("payload", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    return landing.withColumn("_p", parsed)


def rejected_payloads(landing: DataFrame, schema: str) -> DataFrame:
    """Payloads that are not valid JSON of ``schema``, or no payload at all.

    Each payload is either here or a row of its ``ingest_`` function.
    """
    return _parse(landing, schema).where(~_is_read()).drop("_p")


def rejected_repo_payload(landing: DataFrame) -> DataFrame:
    """Payloads that ``ingest_repo_payload`` cannot read."""
    return rejected_payloads(landing, REPO_PAYLOAD)


def rejected_pr_payload(landing: DataFrame) -> DataFrame:
    """Payloads that ``ingest_pr_payload`` cannot read."""
    return rejected_payloads(landing, PR_PAYLOAD)


def rejected_commit_payload(landing: DataFrame) -> DataFrame:
    """Payloads that ``ingest_commit_payload`` cannot read."""
    return rejected_payloads(landing, COMMIT_PAYLOAD)


def _pages(item: str) -> Column:
    """A payload as an array of items (a type); null if it cannot be read as one."""
    return F.from_json("payload", f"array<{item}>")


def rejected_pages(landing: DataFrame, item: str) -> DataFrame:
    """Pages (JSON arrays of the type ``item``) that give no array: broken JSON, no JSON, or no payload at all.

    Each page is either here or read whole by its ``ingest_`` function, where an array without items gives no row.
    """
    return landing.where(_pages(item).isNull())


def rejected_releases_payload(landing: DataFrame) -> DataFrame:
    """Pages that ``ingest_releases_payload`` cannot read."""
    return rejected_pages(landing, f"struct<{RELEASE_PAYLOAD}>")


def rejected_pr_files_payload(landing: DataFrame) -> DataFrame:
    """Pages that ``ingest_pr_files_payload`` cannot read."""
    return rejected_pages(landing, PR_FILE_PAYLOAD)


def _or(column: str, default) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def ingest_releases_payload(landing: DataFrame) -> DataFrame:
    """Releases of (repo, payload), where a payload is one page: a JSON array of releases.

    What cannot be read is in ``rejected_releases_payload``.
    """
    pages = landing.select(
        "repo", F.posexplode(_pages(f"struct<{RELEASE_PAYLOAD}>")).alias("pos", "_r"),
    )
    return pages.select("repo", "_r.*", "pos")


def ingest_repo_payload(landing: DataFrame) -> DataFrame:
    """Repositories with the defaults of optional fields."""
    parsed = _parse(landing, REPO_PAYLOAD).where(_is_read()).select("_p.*").drop(BAD)
    return parsed.withColumns({
        "topics": F.coalesce("topics", F.array().cast("array<string>")),
        "language": _or("language", ""),
        "archived": _or("archived", False),
        "disabled": _or("disabled", False),
        "fork": _or("fork", False),
    })


def ingest_pr_payload(landing: DataFrame) -> DataFrame:
    """Pull requests of (repo, pr_number, payload)."""
    parsed = _parse(landing, PR_PAYLOAD).where(_is_read())
    return parsed.select(
        "repo", "pr_number", "_p.title", "_p.body", "_p.state",
        _or("_p.merged", False).alias("merged"),
        F.col("_p.base.sha").alias("base_sha"), F.col("_p.head.sha").alias("head_sha"),
    )


def ingest_pr_files_payload(landing: DataFrame) -> DataFrame:
    """File changes of (repo, pr_number, payload), where a payload is a JSON array of files.

    What cannot be read is in ``rejected_pr_files_payload``.
    """
    files = landing.select(
        "repo", "pr_number",
        F.posexplode(_pages(PR_FILE_PAYLOAD)).alias("pos", "_f"),
    )
    return files.select(
        "repo", "pr_number", "pos",
        _or("_f.filename", "").alias("filename"),
        _or("_f.status", "").alias("status"),
        _or("_f.additions", 0).alias("additions"),
        _or("_f.deletions", 0).alias("deletions"),
        _or("_f.changes", 0).alias("changes"),
        _or("_f.patch", "").alias("patch"),
        F.col("_f.previous_filename").alias("old_filename"),
    )


def ingest_commit_payload(landing: DataFrame) -> DataFrame:
    """Commits of (repo, payload)."""
    parsed = _parse(landing, COMMIT_PAYLOAD).where(_is_read())
    return parsed.select(
        "repo", "_p.sha",
        _or("_p.commit.message", "").alias("message"),
        _or("_p.commit.author.date", "").alias("date"),
        _or("_p.commit.author.name", "").alias("author"),
    )


def ingest_file_contents(df: DataFrame, col: str = "content_b64") -> DataFrame:
    """Decoded text of base64 file contents; missing or undecodable content is null.

    Line breaks and other characters outside the alphabet do not count.
    """
    letters = F.regexp_replace(col, "[^A-Za-z0-9+/=]", "")
    decoded = F.try_to_binary(letters, F.lit("base64"))
    return df.withColumn("content", F.try_validate_utf8(decoded.cast("string")))
