"""Registered queries on sources, sinks, keyed tables and streams.

Inputs are derived from the given tables by Spark and, where an operator reads files, written
below the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs, layout
from ..schemas import INSTANCE_COLUMNS
from ..session import scratch_dir
from ..sources import documents, keyed, payloads, tables
from ..streaming import incremental
from . import carriers
from .changes import FILES, FLAT, INSTANCE, diff_texts, instances
from .curation import REPO, VALID, valid
from .registry import query

K = "o_orderkey"


def written_text(spark, df, name, records=10_000, compression="none"):
    """Lines in files of at most ``records`` lines."""
    path = scratch_dir(spark, name)
    df.write.option("maxRecordsPerFile", records).option("compression", compression).text(path)
    return path


@query("read_results_document", f"""SELECT CASE WHEN {K} % 19 = 0 THEN '' ELSE {REPO} END AS repository,
  'v' || ({K} % 5) AS release, CAST(0 AS INT) AS pos, 1 + CAST({K} % 3 > 0 AS INT) AS features FROM orders""")
def _(spark, sf):
    entry = F.struct("repository", "release", "analyzed_at", "enhanced_new_features")
    one = F.struct(F.struct(F.lit("now").alias("generated_at")).alias("metadata"), F.array(entry).alias("results"))
    path = written_text(spark, carriers.results_document(spark, sf).select(F.to_json(one)), "results", compression="gzip")
    rows = documents.read_results_document(spark, path, multi_line=False)
    return rows.select("repository", "release", "pos", F.size("enhanced_new_features").alias("features"))


# Documents of a thousand orders each: several entries in every file, so that places count and blocks have borders.
def many_entries(spark, sf):
    return carriers.results_document(spark, sf).withColumn("document", F.expr("pos div 4000"))


@query("read_results_blocks", f"""SELECT CASE WHEN {K} % 19 = 0 THEN '' ELSE {REPO} END AS repository, 'v' || ({K} % 5) AS release,
  row_number() OVER (PARTITION BY {K} // 4000 ORDER BY {K}) - 1 AS pos, 1 + CAST({K} % 3 > 0 AS INT) AS features FROM orders""")
def _(spark, sf):
    entry = F.struct("pos", "repository", "release", "analyzed_at", "enhanced_new_features")
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("pos"))
    one = F.struct(F.struct(F.lit("now").alias("generated_at")).alias("metadata"), entries.alias("results"))
    documents_of = many_entries(spark, sf).groupBy("document").agg(F.to_json(one).alias("value")).select("value")
    path = written_text(spark, documents_of, "result-blocks", records=1)
    rows = documents.read_results_blocks(spark, path, 65_536)
    return rows.select("repository", "release", "pos", F.size("enhanced_new_features").alias("features"))


@query("read_instances_json", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, base_commit, CAST(k % 4 + j AS BIGINT) AS number,
  2 AS n_patch, 1 AS n_test FROM good""")
def _(spark, sf):
    rows = instances(spark, sf).drop("pos")
    lines = rows.select(F.to_json(F.array(F.struct(*rows.columns))))
    path = written_text(spark, lines, "instances")
    found = documents.read_instances_json(spark, path, multi_line=False)
    return found.select("instance_id", "base_commit", "number", F.size("patch").alias("n_patch"),
                        F.size("test_patch").alias("n_test"))


@query("read_instances_published", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, base_commit,
  'src/m_' || j || '.py' AS first_file, 'tests/test_' || j || '.py' AS first_test FROM good""")
def _(spark, sf):
    path = scratch_dir(spark, "published")
    tables.write_published_split(diffs.standardise_instances(instances(spark, sf)), path)
    found = documents.read_instances_published(spark, path)
    return found.select("instance_id", "base_commit", F.get("patch", F.lit(0))["filename"].alias("first_file"),
                        F.get("test_patch", F.lit(0))["filename"].alias("first_test"))


@query("write_published_split", "SELECT 'test' AS split, count(*) AS n FROM orders")
def _(spark, sf):
    path = scratch_dir(spark, "split")
    tables.write_published_split(carriers.specs(spark, sf), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("read_crawl_list", "SELECT 'o/' || c_custkey AS repo FROM customer UNION ALL SELECT 'o/dup' FROM customer")
def _(spark, sf):
    lines = carriers.table(spark, sf, "customer").select(
        F.expr("concat('{\"', c_mktsegment, '\": [\"o/', c_custkey, '\"], \"other\": [\"o/dup\"]}')"))
    return documents.read_crawl_list(spark, written_text(spark, lines, "crawl"), whole=False)


@query("read_keyed_cache", f"SELECT {REPO} || '#' || {K} AS key, {K} AS stars, 'x' || {K} AS note FROM orders")
def _(spark, sf):
    lines = carriers.table(spark, sf, "orders").select(F.expr(
        f"concat('{{\"', {carriers.ORDER_REPO}, '#', o_orderkey, '\": {{\"stars\": ', o_orderkey, ', \"note\": \"x', o_orderkey, '\"}}}}')"))
    path = written_text(spark, lines, "cache")
    return documents.read_keyed_cache(spark, path, "stars bigint, note string", whole=False)


@query("read_patch_files", f"WITH {FILES} SELECT filename, status, old_filename, is_test FROM files")
def _(spark, sf):
    path = written_text(spark, diff_texts(spark, sf).select("diff"), "patches", records=2_000)
    parsed = diffs.parse_unified_diff(documents.read_patch_files(spark, f"{path}/*.txt"), id="path")
    return parsed.select("filename", "status", "old_filename", "is_test")


@query("read_patch_records", f"WITH {FILES} SELECT filename, status, old_filename, is_test FROM files")
def _(spark, sf):
    path = written_text(spark, diff_texts(spark, sf).select("diff"), "patches", records=2_000)
    parsed = diffs.parse_chunks(documents.read_patch_records(spark, f"{path}/*.txt", 65_536))
    return parsed.select("filename", "status", "old_filename", "is_test")


# Payloads of a crawler.
def release_pages(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        f"{carriers.ORDER_REPO} AS repo",
        """CASE WHEN o_orderkey % 5 = 0 THEN '{"message": "rate limited"' ELSE concat(
             '[{"tag_name": "v', o_orderkey, '", "id": 7, "published_at": "2025", "author": ',
             CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{"login": "dev", "id": 1}' END,
             '}, {"tag_name": "w', o_orderkey, '"}]') END AS payload""")


@query("ingest_releases_payload", f"""SELECT {REPO} AS repo, 'v' || {K} AS tag_name, '2025' AS published_at,
   CASE WHEN {K} % 3 > 0 THEN 'dev' END AS login, 0 AS pos FROM orders WHERE {K} % 5 > 0
 UNION ALL SELECT {REPO}, 'w' || {K}, NULL, NULL, 1 FROM orders WHERE {K} % 5 > 0""")
def _(spark, sf):
    rows = payloads.ingest_releases_payload(release_pages(spark, sf))
    return rows.select("repo", "tag_name", "published_at", F.col("author.login").alias("login"), "pos")


@query("rejected_releases_payload", f"""SELECT {REPO} AS repo, '{{"message": "rate limited"' AS payload FROM orders WHERE {K} % 5 = 0""")
def _(spark, sf):
    return payloads.rejected_releases_payload(release_pages(spark, sf)).select("repo", "payload")


def repo_landing(spark, sf):
    return carriers.table(spark, sf, "customer").selectExpr(
        """CASE WHEN c_custkey % 7 = 0 THEN '<html>' ELSE concat('{"full_name": "o/', c_custkey, '", "stargazers_count": ',
             c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ', "topics": ["a", "b"], "language": "Python", "fork": true'
             ELSE ', "language": null' END, '}') END AS payload""")


@query("ingest_repo_payload", """SELECT 'o/' || c_custkey AS full_name, c_custkey AS stargazers_count,
   CASE WHEN c_custkey % 2 = 0 THEN 'a|b' ELSE '' END AS topics, CASE WHEN c_custkey % 2 = 0 THEN 'Python' ELSE '' END AS language,
   c_custkey % 2 = 0 AS fork FROM customer WHERE c_custkey % 7 > 0""")
def _(spark, sf):
    rows = payloads.ingest_repo_payload(repo_landing(spark, sf))
    return rows.select("full_name", "stargazers_count", F.array_join("topics", "|").alias("topics"), "language", "fork")


def pr_landing(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        f"{carriers.ORDER_REPO} AS repo", "cast(o_orderkey AS string) AS pr_number",
        """concat('{"number": ', o_orderkey, ', "title": "T', o_orderkey, '", "state": "closed"',
             CASE WHEN o_orderkey % 2 = 0 THEN ', "merged": true' ELSE '' END,
             ', "base": {"sha": "b', o_orderkey, '", "ref": "main"}, "head": ',
             CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('{"sha": "h', o_orderkey, '"}') END, '}') AS payload""")


@query("ingest_pr_payload", f"""SELECT CAST({K} AS VARCHAR) AS pr_number, 'T' || {K} AS title, {K} % 2 = 0 AS merged,
   'b' || {K} AS base_sha, CASE WHEN {K} % 3 > 0 THEN 'h' || {K} END AS head_sha FROM orders""")
def _(spark, sf):
    return payloads.ingest_pr_payload(pr_landing(spark, sf)).select("pr_number", "title", "merged", "base_sha", "head_sha")


def pr_files_landing(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        f"{carriers.ORDER_REPO} AS repo", "cast(o_orderkey AS string) AS pr_number",
        """concat('[{"filename": "f', o_orderkey, '", "status": "renamed", "additions": 3, "previous_filename": "g',
             o_orderkey, '"}, {"patch": "+x"}]') AS payload""")


@query("ingest_pr_files_payload", f"""SELECT CAST({K} AS VARCHAR) AS pr_number, 0 AS pos, 'f' || {K} AS filename, 'renamed' AS status,
   CAST(3 AS BIGINT) AS additions, '' AS patch, 'g' || {K} AS old_filename FROM orders
 UNION ALL SELECT CAST({K} AS VARCHAR), 1, '', '', 0, '+x', NULL FROM orders""")
def _(spark, sf):
    return payloads.ingest_pr_files_payload(pr_files_landing(spark, sf)).select(
        "pr_number", "pos", "filename", "status", "additions", "patch", "old_filename")


def commit_landing(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        f"{carriers.ORDER_REPO} AS repo",
        """concat('{"sha": "s', o_orderkey, '", "commit": {"message": "M"',
             CASE WHEN o_orderkey % 2 = 0 THEN ', "author": {"name": "Ann"}' ELSE '' END, '}}') AS payload""")


@query("ingest_commit_payload", f"""SELECT 's' || {K} AS sha, 'M' AS message, CASE WHEN {K} % 2 = 0 THEN 'Ann' ELSE '' END AS author,
   '' AS date FROM orders""")
def _(spark, sf):
    return payloads.ingest_commit_payload(commit_landing(spark, sf)).select("sha", "message", "author", "date")


# Landed payloads of all five kinds, some cut off (after eight characters) and some never answered.
PAYLOADS = {
    "releases": (release_pages, payloads.ingest_releases_payload, payloads.rejected_releases_payload),
    "repo": (repo_landing, payloads.ingest_repo_payload, payloads.rejected_repo_payload),
    "pr": (pr_landing, payloads.ingest_pr_payload, payloads.rejected_pr_payload),
    "pr_files": (pr_files_landing, payloads.ingest_pr_files_payload, payloads.rejected_pr_files_payload),
    "commit": (commit_landing, payloads.ingest_commit_payload, payloads.rejected_commit_payload),
}


def landed(spark, sf, kind):
    rows = PAYLOADS[kind][0](spark, sf)
    number = F.regexp_extract("payload", "([0-9]+)", 1).try_cast("bigint")
    return rows.withColumn("payload", F.when(number % 9 == 0, F.left("payload", F.lit(8))).when(number % 10 == 1, None).otherwise(F.col("payload")))


def rejects(kind: str, sql: str):
    """The query of what cannot be read of one kind of payload."""
    @query(f"rejected_{kind}_payloads", sql)
    def _(spark, sf):
        rejected = PAYLOADS[kind][2](landed(spark, sf, kind))
        return rejected.groupBy(F.coalesce("payload", F.lit("none")).alias("payload")).agg(F.count(F.lit(1)).alias("n"))


def cut_or_none(table: str, key: str, start: str) -> str:
    return f"""SELECT CASE WHEN {key} % 9 = 0 THEN '{start}' ELSE 'none' END AS payload, count(*) AS n FROM {table}
 WHERE {key} % 9 = 0 OR {key} % 10 = 1 GROUP BY 1"""


rejects("pr", cut_or_none("orders", K, '{"number'))
rejects("pr_files", cut_or_none("orders", K, '[{"filen'))
rejects("commit", cut_or_none("orders", K, '{"sha": '))
rejects("repo", """SELECT CASE WHEN c_custkey % 7 = 0 THEN '<html>' WHEN c_custkey % 9 = 0 THEN '{"full_n' ELSE 'none' END AS payload,
 count(*) AS n FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 9 = 0 OR c_custkey % 10 = 1 GROUP BY 1""")


@query("payload_balance", f"""SELECT kind, n AS payloads, n - bad AS read, bad AS rejected FROM (
 SELECT 'pr' AS kind, count(*) AS n, count(*) FILTER ({K} % 9 = 0 OR {K} % 10 = 1) AS bad FROM orders
 UNION ALL SELECT 'commit', count(*), count(*) FILTER ({K} % 9 = 0 OR {K} % 10 = 1) FROM orders
 UNION ALL SELECT 'repo', count(*), count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 9 = 0 OR c_custkey % 10 = 1) FROM customer)""")
def _(spark, sf):
    sides = []
    for kind in ("pr", "commit", "repo"):  # one payload, one row
        _landing, ingest, rejected = PAYLOADS[kind]
        rows = landed(spark, sf, kind)
        for side, df in (("payloads", rows), ("read", ingest(rows)), ("rejected", rejected(rows))):
            sides.append(df.select(F.lit(kind).alias("kind"), F.lit(side).alias("side")))
    counts = sides[0]
    for df in sides[1:]:
        counts = counts.union(df)
    return counts.groupBy("kind").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("payloads", "read", "rejected")])


@query("ingest_file_contents", "SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN text END AS content FROM documents")
def _(spark, sf):
    docs = carriers.table(spark, sf, "documents").selectExpr(
        "doc_id", """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN base64(unhex('ff00fe'))
            ELSE regexp_replace(base64(encode(text, 'UTF-8')), '(.{60})', '$1\n') END AS content_b64""")
    return payloads.ingest_file_contents(docs).select("doc_id", "content")


# Writers and keyed tables.
@query("write_instances", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, base_commit, '{','.join(INSTANCE_COLUMNS)}' AS columns
 FROM good""")
def _(spark, sf):
    path = scratch_dir(spark, "instances")
    tables.write_instances(instances(spark, sf), path)
    found = spark.read.parquet(path)
    return found.select("instance_id", "base_commit", F.lit(",".join(found.columns)).alias("columns"))


@query("write_final_results", f"""SELECT count(DISTINCT o_custkey) AS total_repositories,
  count(DISTINCT {REPO} || '#' || ({K} % 5)) AS total_releases, count(*) AS total_enhanced_features FROM orders""")
def _(spark, sf):
    path = scratch_dir(spark, "final")
    tables.write_final_results(carriers.features(spark, sf), path)
    schema = "total_repositories bigint, total_releases bigint, total_enhanced_features bigint"
    return spark.read.schema(schema).json(f"{path}/metadata")


LATEST = f"""SELECT {REPO} AS repo, arg_max({K}, [CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, {K}]) AS value
 FROM orders GROUP BY 1"""


def versions(spark, sf, condition):
    rows = carriers.table(spark, sf, "orders").where(condition)
    return rows.selectExpr(f"{carriers.ORDER_REPO} AS repo", "o_orderkey AS value", "o_orderkey AS seq")


@query("upsert_keyed_cache", LATEST)
def _(spark, sf):
    old, new = versions(spark, sf, "o_orderstatus = 'F'"), versions(spark, sf, "o_orderstatus <> 'F'")
    return tables.upsert_keyed_cache(old, new, ["repo"], "seq").drop("seq")


@query("read_keyed", LATEST)
def _(spark, sf):
    path = scratch_dir(spark, "keyed")
    tables.append_batch(versions(spark, sf, "o_orderstatus = 'F'"), path, 0)
    tables.append_batch(versions(spark, sf, "o_orderstatus <> 'F'"), path, 1)
    return tables.read_keyed(spark, path, ["repo"], "seq").drop("seq")


@query("upsert_buckets", LATEST)
def _(spark, sf):
    path = scratch_dir(spark, "buckets")
    for batch, condition in enumerate(("o_orderstatus = 'F'", "o_orderstatus <> 'F'", "o_orderstatus = 'O'")):  # the last is a part once more
        keyed.upsert_buckets(versions(spark, sf, condition), path, ["repo"], "seq", min(batch, 1), buckets=16)
    return keyed.read_buckets(spark, path).drop("seq")


@query("stream_upsert_buckets", f"SELECT {REPO} AS repo, max({K}) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    rows = carriers.stream_table(spark, sf, "orders").selectExpr(f"{carriers.ORDER_REPO} AS repo", "o_orderkey AS value")
    path = scratch_dir(spark, "upsert-buckets")
    incremental.stream_upsert_buckets(rows, path, scratch_dir(spark, "state"), ["repo"], "value", buckets=16).awaitTermination()
    return keyed.read_buckets(spark, path)


@query("stream_eval_results", """SELECT event_type AS agent, count(*) AS n, count(*) FILTER (WHERE success) AS resolved FROM (
   SELECT event_type, user_id, arg_max(event_type <> 'error' AND value > 20, ts) AS success FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    rows = carriers.eval_results_of(carriers.stream_table(spark, sf, "events"))
    path = scratch_dir(spark, "eval-results")
    incremental.stream_eval_results(rows, path, scratch_dir(spark, "state"), buckets=16).awaitTermination()
    return incremental.progress_of(keyed.read_buckets(spark, path))


@query("load_results", "SELECT DISTINCT event_type AS agent, 'i' || user_id AS instance_id FROM events")
def _(spark, sf):
    path = scratch_dir(spark, "results")
    rows = carriers.eval_results(spark, sf)
    tables.save_results(rows.where("agent = 'click'"), path, "a")
    tables.save_results(rows.where("agent <> 'click'"), path, "b")
    _results, keys = tables.load_results(spark, path)
    return keys


@query("store_test_logs", f"""SELECT 'i' || {K} AS instance_id, 'pre' AS phase,
  CASE WHEN o_orderstatus = 'F' THEN 'second ' ELSE 'first ' END || {K} AS log FROM orders""")
def _(spark, sf):
    path = scratch_dir(spark, "logs")
    logs = carriers.table(spark, sf, "orders").selectExpr(
        "concat('i', o_orderkey) AS instance_id", "'pre' AS phase", "concat('first ', o_orderkey) AS log", "o_orderkey", "o_orderstatus")
    tables.store_test_logs(logs, path, 0)
    again = logs.where("o_orderstatus = 'F'").withColumn("log", F.expr("concat('second ', o_orderkey)"))
    tables.store_test_logs(again, path, 1)
    return tables.read_keyed(spark, path, ["instance_id", "phase"])


@query("last_per_key", f"SELECT {REPO} AS repo, max({K}) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    return layout.last_per_key(versions(spark, sf, "true"), ["repo"], ["seq"]).drop("seq")


# Streams run until the files at hand are used up, then their result is read back.
@query("stream_upsert_keyed", f"SELECT {REPO} AS repo, max({K}) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    rows = carriers.stream_table(spark, sf, "orders").selectExpr(
        f"{carriers.ORDER_REPO} AS repo", "o_orderkey AS value")
    path = scratch_dir(spark, "upsert")
    incremental.stream_upsert_keyed(rows, path, scratch_dir(spark, "state"), ["repo"], "value").awaitTermination()
    return tables.read_keyed(spark, path, ["repo"], "value")


@query("stream_new_releases", f"""SELECT DISTINCT {REPO} AS repo, {K} % 5 AS tag FROM orders WHERE {VALID}""")
def _(spark, sf):
    rows = carriers.releases_of(carriers.stream_table(spark, sf, "orders"))
    rows = rows.withColumn("tag_name", (F.col("pos") % 5).cast("string"))
    path = scratch_dir(spark, "releases")
    fresh = incremental.stream_new_releases(rows, valid()).select("repo", "tag_name", "published")
    incremental.append_to(fresh, path, scratch_dir(spark, "state")).awaitTermination()
    return spark.read.parquet(path).select("repo", F.col("tag_name").cast("bigint").alias("tag"))


@query("stream_eval_progress", """WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type AS agent,
   count(*) AS n, count(*) FILTER (WHERE event_type <> 'error' AND value > 20) AS resolved FROM events GROUP BY ALL)
 SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, agent, n, resolved FROM w
 WHERE window_start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    rows = carriers.eval_results_of(carriers.stream_table(spark, sf, "events"))
    rows = rows.withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    path = scratch_dir(spark, "progress")
    windows = incremental.stream_eval_progress(rows)
    incremental.append_to(windows, path, scratch_dir(spark, "state")).awaitTermination()
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm")
    return spark.read.parquet(path).select(start.alias("window_start"), "agent", "n", "resolved")
