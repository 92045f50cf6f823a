"""Registered queries on repositories, releases and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import curation, repos, sets
from . import carriers
from .registry import query

REPO = "'o' || (o_custkey % 7) || '/r' || o_custkey"
MIN_DATE = "1998-01-01"
VALID = (
    "o_orderpriority <> '5-LOW' AND o_orderkey % 17 <> 0 AND o_orderkey % 100 >= 50 "
    f"AND o_orderkey % 11 <> 0 AND o_orderdate >= TIMESTAMP '{MIN_DATE}'"
)
A, B, C = "(o_orderkey % 5)", "(o_orderkey % 13)", "(o_orderkey % 29)"
VERSION_KEY = f"CASE WHEN o_orderkey % 6 < 5 THEN {A} || '.' || {B} || '.' || {C} END"


def valid():
    return curation.is_valid_release(min_date=MIN_DATE)


@query("filter_bot_authors", f"SELECT o_orderkey AS pos, {REPO} AS repo FROM orders WHERE o_orderpriority <> '5-LOW'")
def _(spark, sf):
    return curation.filter_bot_authors(carriers.releases(spark, sf)).select("pos", "repo")


@query("filter_min_body", """SELECT doc_id, lang FROM documents
 WHERE length(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) >= 50""")
def _(spark, sf):
    docs = carriers.table(spark, sf, "documents")
    return curation.filter_min_body(docs, "text", 50).select("doc_id", "lang")


@query("filter_min_date", f"""SELECT o_orderkey AS pos, {REPO} AS repo FROM orders
 WHERE o_orderkey % 11 <> 0 AND o_orderdate >= TIMESTAMP '{MIN_DATE}'""")
def _(spark, sf):
    return curation.filter_min_date(carriers.releases(spark, sf), min_date=MIN_DATE).select("pos", "repo")


@query("is_valid_release", f"SELECT o_orderkey AS pos, ({VALID}) AS valid FROM orders")
def _(spark, sf):
    return carriers.releases(spark, sf).select("pos", valid().alias("valid"))


CUST_REPO = "'o' || (c_custkey % 7) || '/r' || c_custkey"


@query("filter_excluded_topics", f"""SELECT {CUST_REPO} AS full_name FROM customer
 WHERE c_custkey % 13 = 0 OR c_mktsegment <> 'MACHINERY'""")
def _(spark, sf):
    return curation.filter_excluded_topics(carriers.repos(spark, sf)).select("full_name")


@query("filter_min_valid_releases", f"""
 SELECT {CUST_REPO} AS full_name, n AS releases_count FROM customer JOIN (
   SELECT o_custkey, count(*) AS n FROM orders WHERE {VALID} GROUP BY 1 HAVING count(*) >= 2)
 ON c_custkey = o_custkey""")
def _(spark, sf):
    good = carriers.releases(spark, sf).where(valid())
    found = curation.filter_min_valid_releases(carriers.repos(spark, sf), good, n=2)
    return found.select("full_name", "releases_count")


@query("valid_release_count", f"""
 SELECT {REPO} AS repo, count(*) FILTER (WHERE {VALID}) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return curation.valid_release_count(carriers.releases(spark, sf), valid())


@query("filter_language_stars", f"""
 SELECT {CUST_REPO} AS full_name, CAST(round(c_acctbal * 10) AS BIGINT) AS stargazers_count
 FROM customer WHERE c_nationkey % 2 = 0 AND round(c_acctbal * 10) >= 50000""")
def _(spark, sf):
    found = curation.filter_language_stars(carriers.repos(spark, sf), min_stars=50_000)
    return found.select("full_name", "stargazers_count")


@query("exclude_prerelease", "SELECT o_orderkey AS pos FROM orders WHERE o_orderkey % 6 NOT IN (3, 4)")
def _(spark, sf):
    return curation.exclude_prerelease(carriers.releases(spark, sf)).select("pos")


@query("extract_version", f"""SELECT o_orderkey AS pos, {VERSION_KEY} AS version_key,
 CASE WHEN o_orderkey % 6 < 5 THEN 3 END AS parts FROM orders""")
def _(spark, sf):
    version = text.extract_version(F.col("tag_name"))
    return carriers.releases(spark, sf).select(
        "pos", text.version_key(version).alias("version_key"),
        F.when(version.isNotNull(), F.size(version)).alias("parts"),
    )


@query("extract_version_from_urls", r"""SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]') THEN array_to_string(
  regexp_extract_all(regexp_extract(url, '([0-9]+)(?:\s*[.\-_]\s*[0-9]+)*', 0), '[0-9]+'), '.') END AS version_key
 FROM pages""")
def _(spark, sf):
    version = text.extract_version(F.col("url"))
    return carriers.table(spark, sf, "pages").select("page_id", text.version_key(version).alias("version_key"))


@query("version_key", f"SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 6 < 5 THEN {VERSION_KEY} END AS version_key FROM orders")
def _(spark, sf):
    version = text.extract_version(F.col("tag_name"))
    return carriers.releases(spark, sf).select("pos", text.version_key(version).alias("version_key"))


TOP = f"""SELECT * FROM (
 SELECT o_orderkey AS pos, {REPO} AS repo, {VERSION_KEY} AS version_key, CAST(row_number() OVER (
   PARTITION BY o_custkey ORDER BY {A} DESC, {B} DESC, {C} DESC, o_orderkey) AS INT) AS rank
 FROM orders WHERE o_orderkey % 6 < 3) WHERE rank <= 3"""


@query("top_releases_per_repo", TOP)
def _(spark, sf):
    top = curation.top_releases_per_repo(carriers.releases(spark, sf), n=3)
    return top.select("pos", "repo", "version_key", "rank")


@query("require_release", f"""SELECT {CUST_REPO} AS full_name FROM customer
 WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 < 3)""")
def _(spark, sf):
    top = curation.top_releases_per_repo(carriers.releases(spark, sf))
    return curation.require_release(carriers.repos(spark, sf), top).select("full_name")


@query("rank_range", f"""SELECT * FROM (
 SELECT {CUST_REPO} AS full_name, CAST(row_number() OVER (
   ORDER BY CAST(round(c_acctbal * 10) AS BIGINT) DESC, {CUST_REPO}) AS INT) AS rank FROM customer)
 WHERE rank BETWEEN 11 AND 100""")
def _(spark, sf):
    return curation.rank_range(carriers.repos(spark, sf), start=11).select("full_name", "rank")


@query("release_context", f"""SELECT o_orderkey AS pos, CASE WHEN c_custkey % 3 <> 0
   THEN '# ' || c_name ELSE '' END AS readme
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    joined = curation.release_context(carriers.releases(spark, sf), carriers.repos(spark, sf))
    return joined.select("pos", "readme")


@query("skip_cached", f"""SELECT {CUST_REPO} AS full_name, 'new' AS origin FROM customer
   WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
 UNION ALL SELECT DISTINCT {REPO}, 'cached' FROM orders
   WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer)""")
def _(spark, sf):
    cache = carriers.table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr(
        f"{carriers.ORDER_REPO} AS full_name").distinct()
    fresh, cached = curation.skip_cached(carriers.repos(spark, sf).select("full_name"), cache, ["full_name"])
    return sets.union_all(
        fresh.withColumn("origin", F.lit("new")), cached.withColumn("origin", F.lit("cached"))
    )


@query("feature_type_counts", f"""SELECT {REPO} AS repo,
  count(*) FILTER (WHERE o_orderkey % 4 = 0) AS new_features,
  count(*) FILTER (WHERE o_orderkey % 4 = 1) AS improvements,
  count(*) FILTER (WHERE o_orderkey % 4 = 2) AS bug_fixes,
  grouping({REPO}) AS is_total
 FROM orders GROUP BY ROLLUP ({REPO})""")
def _(spark, sf):
    counts = curation.feature_type_counts(carriers.features(spark, sf))
    return counts.withColumn("is_total", F.col("is_total").cast("bigint"))


@query("results_metadata", f"""SELECT count(DISTINCT o_custkey) AS total_repositories,
  count(DISTINCT {REPO} || '#' || (o_orderkey % 5)) AS total_releases,
  count(*) AS total_enhanced_features FROM orders""")
def _(spark, sf):
    return curation.results_metadata(carriers.features(spark, sf))


KEY = "(p_partkey // 10)"


@query("has_test_suite", f"""SELECT 'o/r' || {KEY} AS repo,
  bool_or(p_partkey % 10 = 2 AND {KEY} % 4 < 3) AS has_tests FROM part GROUP BY 1""")
def _(spark, sf):
    return repos.has_test_suite(carriers.repo_tree(spark, sf))


@query("detect_test_dirs", f"""WITH found AS (
  SELECT {KEY} AS k, 'tests' AS d, true AS root FROM part WHERE p_partkey % 10 = 2 AND {KEY} % 4 = 0
  UNION SELECT {KEY}, 'docs/tests', false FROM part WHERE p_partkey % 10 = 2 AND {KEY} % 4 = 3
  UNION SELECT {KEY}, 'pkg/unit_tests', false FROM part WHERE p_partkey % 10 = 7 AND {KEY} % 5 = 0)
 SELECT 'o/r' || k AS repo, d AS test_dir FROM found
  WHERE root OR k NOT IN (SELECT k FROM found WHERE root)
 UNION ALL SELECT DISTINCT 'o/r' || {KEY}, 'tests' FROM part WHERE {KEY} NOT IN (SELECT k FROM found)""")
def _(spark, sf):
    return repos.detect_test_dirs(carriers.repo_tree(spark, sf))


@query("pick_readme", f"""SELECT 'o/r' || {KEY} AS repo, coalesce(
   max('# ' || p_name || p_partkey) FILTER (WHERE p_partkey % 10 = 0 AND {KEY} % 3 <> 0),
   max('# ' || p_name || p_partkey) FILTER (WHERE p_partkey % 10 = 8 AND {KEY} % 7 <> 0), '') AS readme
 FROM part GROUP BY 1""")
def _(spark, sf):
    return repos.pick_readme(carriers.repo_tree(spark, sf))


@query("collect_ci_configs", f"""SELECT 'o/r' || {KEY} AS repo,
  '.github/workflows/ci' || p_size || '.yml' AS path, 'https://h/' || p_partkey AS url
 FROM part WHERE p_partkey % 10 = 4 AND p_partkey % 3 <> 0""")
def _(spark, sf):
    maps = repos.collect_ci_configs(carriers.repo_tree(spark, sf))
    return maps.select("repo", F.explode("ci_configs").alias("path", "url"))


@query("repo_dimension_lookup", f"""SELECT o_orderkey AS pos, CASE WHEN c_acctbal > 0
  THEN '3.' || c_nationkey ELSE '3.9' END AS python_version
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    dim = carriers.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr(
        "concat('o', c_custkey % 7, '_r', c_custkey) AS repo_key",
        "concat('3.', c_nationkey) AS python_version",
    )
    found = repos.repo_dimension_lookup(
        carriers.releases(spark, sf), dim, "python_version", F.lit("3.9"))
    return found.select("pos", "python_version")


IMAGE = f"""CASE o_orderkey % 6 WHEN 0 THEN 'hub.io/a/b:' || (o_orderkey % 50)
   WHEN 1 THEN 'reg/p/bench_x:' || (o_orderkey % 50) WHEN 2 THEN NULL
   ELSE CASE WHEN o_orderkey <> 0 THEN 'reg/p/bench_o' || (o_custkey % 7) || '_r' || o_custkey
        || ':' || o_orderkey END END"""


@query("image_name", f"SELECT o_orderkey AS number, {IMAGE} AS image FROM orders")
def _(spark, sf):
    name = text.image_name(F.col("repo"), F.col("number"), F.col("docker_image"), prefix="reg/p")
    return carriers.specs(spark, sf).select("number", name.alias("image"))


@query("distinct_images", f"SELECT DISTINCT image FROM (SELECT {IMAGE} AS image FROM orders) WHERE image IS NOT NULL")
def _(spark, sf):
    return repos.distinct_images(carriers.specs(spark, sf), prefix="reg/p")


NAME = """CASE WHEN l_returnflag = 'A' THEN 'src/mod_' || l_partkey || '.py'
  WHEN l_returnflag = 'N' THEN 'Tests/test_' || l_partkey || '.py'
  WHEN l_linestatus = 'O' THEN 'contest/foo_' || l_partkey || '.py'
  WHEN l_partkey % 2 = 0 THEN 'docs/' || l_partkey || '.md' END"""


@query("is_test_path", f"SELECT {NAME} AS filename, l_returnflag = 'N' AS is_test FROM lineitem")
def _(spark, sf):
    return carriers.file_changes(spark, sf).select(
        "filename", paths.is_test_path(F.col("filename")).alias("is_test"))


@query("is_test_patch", f"""SELECT {NAME} AS filename,
  l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linestatus = 'O') AS is_test FROM lineitem""")
def _(spark, sf):
    return carriers.file_changes(spark, sf).select(
        "filename", paths.is_test_patch(F.col("filename")).alias("is_test"))


@query("path_rules_on_urls", """SELECT page_id, regexp_matches(lower(url), 'test.*\\.py$') AS patch_rule,
  len(list_filter(string_split(lower(url), '/'), lambda p: p IN ('test', 'tests', 'testing', 'spec', 'specs'))) > 0
  AND regexp_matches(list_extract(string_split(url, '/'), -1), '^(test_.*\\.py$|.*_test\\.py$|.*_spec\\.py$|conftest\\.py$)')
  AS mining_rule FROM pages""")
def _(spark, sf):
    url = F.col("url")
    return carriers.table(spark, sf, "pages").select(
        "page_id", paths.is_test_patch(url).alias("patch_rule"), paths.is_test_path(url).alias("mining_rule"))


@query("set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' "
       "EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    orders = carriers.table(spark, sf, "orders")
    return sets.set_difference(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("set_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' "
       "INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    orders = carriers.table(spark, sf, "orders")
    return sets.set_intersection(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("union_all", "SELECT c_custkey AS key, 1 AS side FROM customer UNION ALL SELECT o_custkey, 2 FROM orders")
def _(spark, sf):
    return sets.union_all(
        carriers.table(spark, sf, "customer").selectExpr("c_custkey AS key", "1 AS side"),
        carriers.table(spark, sf, "orders").selectExpr("o_custkey AS key", "2 AS side"))


@query("union_distinct", "SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders")
def _(spark, sf):
    return sets.union_all(
        carriers.table(spark, sf, "customer").selectExpr("c_custkey AS key"),
        carriers.table(spark, sf, "orders").selectExpr("o_custkey AS key"), distinct=True)
