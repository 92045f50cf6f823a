"""Registered queries on diffs, file changes, symbols and the transform to instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs as diff_columns
from ..functions import text
from ..operators import diffs, prompts, symbols, transform
from . import carriers
from .curation import NAME, REPO
from .registry import query

K = "o_orderkey"
# The file changes behind the diffs of an order, one row per file.
FILES = f"""files AS (
  SELECT 'i' || {K} AS instance_id, 0 AS pos, {K} AS k, 'src/a_' || {K} || '.py' AS filename, 'modified' AS status,
    CAST(NULL AS VARCHAR) AS old_filename, false AS is_test, '@@ -1,2 +1,'
      || CASE WHEN {K} % 10 = 0 THEN 9 ELSE 1 + {K} % 4 END || ' @@' || chr(10) || ' ctx' || chr(10) || '-old'
      || repeat(chr(10) || '+new', {K} % 4) AS patch FROM orders
  UNION ALL SELECT 'i' || {K}, 1, {K}, 'tests/test_' || {K} || '.py', 'added', NULL, true,
    '@@ -0,0 +1 @@' || chr(10) || '+x = ' || {K} || chr(10) || '\\ No newline at end of file' FROM orders
  UNION ALL SELECT 'i' || {K}, 2, {K}, 'docs/n_' || {K} || '.md', 'renamed', 'docs/o_' || {K} || '.md', false, ''
    FROM orders WHERE {K} % 3 = 0
  UNION ALL SELECT 'i' || {K}, 2, {K}, 'old/r_' || {K} || '.py', 'removed', NULL, false,
    '@@ -1 +0,0 @@' || chr(10) || '-gone' FROM orders WHERE {K} % 3 = 1)"""
FILE_DIFF = """CASE status
   WHEN 'added' THEN 'diff --git a/' || filename || ' b/' || filename || chr(10) || 'new file mode 100644' || chr(10)
     || 'index 0000000..1111111' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || filename || chr(10) || patch
   WHEN 'removed' THEN 'diff --git a/' || filename || ' b/' || filename || chr(10) || 'deleted file mode 100644' || chr(10)
     || 'index 1111111..0000000' || chr(10) || '--- a/' || filename || chr(10) || '+++ /dev/null' || chr(10) || patch
   WHEN 'renamed' THEN 'diff --git a/' || old_filename || ' b/' || filename || chr(10) || 'similarity index 100%' || chr(10)
     || 'rename from ' || old_filename || chr(10) || 'rename to ' || filename || CASE WHEN patch = '' THEN '' ELSE chr(10) || patch END
   ELSE 'diff --git a/' || filename || ' b/' || filename || chr(10) || 'index 1111111..2222222 100644' || chr(10)
     || '--- a/' || filename || chr(10) || '+++ b/' || filename || chr(10) || patch END"""
DIFFS = f"""{FILES}, diffs AS (SELECT instance_id, any_value(k) AS k,
   string_agg({FILE_DIFF}, chr(10) ORDER BY pos) AS diff FROM files GROUP BY 1)"""


def diff_texts(spark, sf):
    lists = carriers.patch_lists(spark, sf)
    return lists.select("instance_id", diff_columns.assemble_diff(F.col("patches")).alias("diff"))


def patch_files(spark, sf):
    return diffs.parse_unified_diff(diff_texts(spark, sf))


@query("build_file_diff", f"WITH {FILES} SELECT instance_id, pos, {FILE_DIFF} AS diff FROM files")
def _(spark, sf):
    rows = carriers.patch_lists(spark, sf).select(
        "instance_id", F.posexplode("patches").alias("pos", "p"))
    one = diff_columns.build_file_diff(
        F.col("p.filename"), F.col("p.status"), F.col("p.patch"), F.col("p.old_filename"))
    return rows.select("instance_id", "pos", F.regexp_replace(one, r"\n+\z", "").alias("diff"))


@query("assemble_diff", f"WITH {DIFFS} SELECT instance_id, diff FROM diffs")
def _(spark, sf):
    return diff_texts(spark, sf)


@query("parse_unified_diff", f"""WITH {FILES} SELECT instance_id, pos, filename, status, old_filename,
  patch, is_test FROM files""")
def _(spark, sf):
    return patch_files(spark, sf)


@query("extract_file_info", f"WITH {FILES} SELECT instance_id, filename, status, old_filename FROM files")
def _(spark, sf):
    chunks = diff_texts(spark, sf).select(
        "instance_id", F.explode(diff_columns.split_files(F.col("diff"))).alias("chunk"))
    info = diff_columns.extract_file_info(diff_columns.chunk_lines(F.col("chunk")))
    return chunks.select("instance_id", info.alias("info")).select("instance_id", "info.*")


@query("extract_hunks", f"WITH {FILES} SELECT instance_id, patch FROM files")
def _(spark, sf):
    chunks = diff_texts(spark, sf).select(
        "instance_id", F.explode(diff_columns.split_files(F.col("diff"))).alias("chunk"))
    return chunks.select(
        "instance_id", diff_columns.extract_hunks(diff_columns.chunk_lines(F.col("chunk"))).alias("patch"))


@query("filter_patch_kind", f"WITH {FILES} SELECT instance_id, filename FROM files WHERE NOT is_test")
def _(spark, sf):
    return diffs.filter_patch_kind(patch_files(spark, sf), include_test=False).select("instance_id", "filename")


@query("validate_diff", f"""WITH {FILES} SELECT instance_id, filename AS path, 0 AS hunk,
  NOT (status = 'modified' AND k % 10 = 0) AS ok FROM files WHERE status <> 'renamed'""")
def _(spark, sf):
    return diffs.validate_diff(diff_texts(spark, sf))


@query("invalid_instances", "SELECT 'i' || o_orderkey AS instance_id FROM orders WHERE o_orderkey % 10 = 0")
def _(spark, sf):
    return diffs.invalid_instances(diffs.validate_diff(diff_texts(spark, sf)))


@query("diff_kind_counts", """SELECT 'i' || o_orderkey AS instance_id,
  CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 3 END::BIGINT AS files, 1::BIGINT AS test_files FROM orders""")
def _(spark, sf):
    return diffs.diff_kind_counts(patch_files(spark, sf))


@query("standardise_instances", f"""WITH {FILES}
 SELECT instance_id, string_agg({FILE_DIFF}, chr(10) ORDER BY pos) FILTER (WHERE NOT is_test) AS patch,
  string_agg({FILE_DIFF}, chr(10) ORDER BY pos) FILTER (WHERE is_test) AS test_patch,
  count(*) FILTER (WHERE NOT is_test)::INT AS n_patch, count(*) FILTER (WHERE is_test)::INT AS n_test
 FROM files GROUP BY 1""")
def _(spark, sf):
    lists = carriers.patch_lists(spark, sf)
    test = lambda p: p["filename"].startswith("tests/")
    rows = lists.select(
        "instance_id", F.filter("patches", lambda p: ~test(p)).alias("patch"),
        F.filter("patches", test).alias("test_patch"))
    return diffs.standardise_instances(rows).select(
        "instance_id", "patch", "test_patch", F.size("patch_files").alias("n_patch"),
        F.size("test_patch_files").alias("n_test"))


@query("filter_applicable_changes", f"""SELECT 'i' || l_orderkey AS instance_id, {NAME} AS filename
 FROM lineitem WHERE l_suppkey % 3 = 2 AND {NAME} IS NOT NULL""")
def _(spark, sf):
    return diffs.filter_applicable_changes(carriers.file_changes(spark, sf)).select("instance_id", "filename")


@query("change_size_stats", """SELECT 'i' || l_orderkey AS instance_id, l_returnflag = 'N' AS is_test,
  count(*) AS files, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions,
  sum(l_quantity + l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS changes,
  count(*) FILTER (WHERE l_partkey % 10 = 0) AS inconsistent FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    from ..functions.paths import is_test_path

    rows = carriers.file_changes(spark, sf).withColumn("is_test", is_test_path(F.col("filename")))
    return diffs.change_size_stats(rows)


# Files that the diffs of an order apply to; every seventh has other text, so its hunk fails.
def old_files(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        "concat('i', o_orderkey) AS instance_id",
        r"""explode(array(
          named_struct('path', concat('src/a_', o_orderkey, '.py'), 'content',
            CASE WHEN o_orderkey % 7 = 0 THEN 'other\nold\n' ELSE 'ctx\nold\ntail\n' END),
          named_struct('path', concat('docs/o_', o_orderkey, '.md'), 'content', 'doc'),
          named_struct('path', concat('old/r_', o_orderkey, '.py'), 'content', 'gone\n'))) AS f""",
    ).select("instance_id", "f.*")


OK = "(NOT (status = 'modified' AND (k % 7 = 0 OR k % 10 = 0)))"


@query("apply_hunks", f"""SELECT 'i' || {K} AS instance_id, 'src/a_' || {K} || '.py' AS path,
   CASE WHEN {K} % 7 = 0 THEN 'other' || chr(10) || 'old' || chr(10)
     WHEN {K} % 10 = 0 THEN 'ctx' || chr(10) || 'old' || chr(10) || 'tail' || chr(10)
     ELSE 'ctx' || chr(10) || repeat('new' || chr(10), {K} % 4) || 'tail' || chr(10) END AS content FROM orders
 UNION ALL SELECT 'i' || {K}, 'tests/test_' || {K} || '.py', 'x = ' || {K} FROM orders
 UNION ALL SELECT 'i' || {K}, CASE WHEN {K} % 3 = 0 THEN 'docs/n_' ELSE 'docs/o_' END || {K} || '.md', 'doc' FROM orders
 UNION ALL SELECT 'i' || {K}, 'old/r_' || {K} || '.py', 'gone' || chr(10) FROM orders WHERE {K} % 3 <> 1""")
def _(spark, sf):
    after, _status = diffs.apply_hunks(old_files(spark, sf), patch_files(spark, sf))
    return after


@query("apply_hunks_status", f"WITH {FILES} SELECT instance_id, pos, filename, status, {OK} AS ok FROM files")
def _(spark, sf):
    _after, status = diffs.apply_hunks(old_files(spark, sf), patch_files(spark, sf))
    return status


@query("patch_application_summary", f"""WITH {DIFFS}, done AS (SELECT instance_id, count(*) AS total_files_num,
   count(*) FILTER (WHERE {OK}) AS applied_files_num, string_agg(filename, '|' ORDER BY pos) FILTER (WHERE {OK}) AS applied_files
   FROM files GROUP BY 1)
 SELECT instance_id, 0::BIGINT AS chunk, total_files_num, applied_files_num, applied_files, diff AS patch_content
 FROM done JOIN diffs USING (instance_id)""")
def _(spark, sf):
    chosen = diffs.filter_patch_kind(patch_files(spark, sf))  # tests and sources
    _after, status = diffs.apply_hunks(old_files(spark, sf), chosen)
    summary = diffs.patch_application_summary(status, diff_texts(spark, sf))
    return summary.withColumn("applied_files", F.array_join("applied_files", "|"))


@query("applied_files", f"""WITH {FILES} SELECT instance_id, 0::BIGINT AS chunk,
  string_agg(filename, '|' ORDER BY pos) AS applied_files FROM files WHERE {OK} GROUP BY 1""")
def _(spark, sf):
    _after, status = diffs.apply_hunks(old_files(spark, sf), patch_files(spark, sf))
    return diffs.applied_files(status).withColumn("applied_files", F.array_join("applied_files", "|"))


# Several patches of the same files: edits on edits, a rename between two edits, a file added, edited and removed again, and
# patches that fail because of what others left.
def chain_files(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        "concat('i', o_orderkey) AS instance_id",
        r"""inline(array_compact(array(
          named_struct('path', 'src/c.py', 'content', concat('one\ntwo\nthree ', o_orderkey, '\n')),
          named_struct('path', 'README.md', 'content', concat('# ', o_orderkey)),
          CASE WHEN o_orderkey % 4 = 0 THEN named_struct('path', 'src/d.py', 'content', 'x') END)))""",
    )


def chain_patches(spark, sf):
    def patch(pos: int, filename: str, status: str, patch: str, old: str = "NULL") -> str:
        return (f"named_struct('pos', {pos}, 'filename', {filename}, 'status', '{status}', "
                f"'old_filename', cast({old} AS string), 'patch', {patch})")

    moved, rows = "CASE WHEN o_orderkey % 3 = 0 THEN 'lib/c.py' ELSE 'src/c.py' END", carriers.spread(carriers.table(spark, sf, "orders"))
    return rows.selectExpr(
        "concat('i', o_orderkey) AS instance_id",
        f"""inline(array_compact(array(
          {patch(0, "'src/c.py'", "modified", "concat('@@ -1 +1,2 @@\\n-one\\n+ONE\\n+', o_orderkey)")},
          CASE WHEN o_orderkey % 3 = 0 THEN {patch(1, "'lib/c.py'", "renamed", "''", "'src/c.py'")} END,
          {patch(2, moved, "modified", "concat('@@ -4 +4 @@\\n-three ', o_orderkey, '\\n+3')")},
          {patch(3, "'src/c.py'", "modified", "'@@ -1 +1 @@\\n-one\\n+late'")},
          {patch(4, "'new.py'", "added", "'@@ -0,0 +1 @@\\n+v'")},
          {patch(5, "'new.py'", "modified", "concat('@@ -1 +1,2 @@\\n v\\n+', o_orderkey, '\\n\\\\ No newline at end of file')")},
          CASE WHEN o_orderkey % 5 = 0 THEN {patch(6, "'new.py'", "removed", "concat('@@ -1,2 +0,0 @@\\n-v\\n-', o_orderkey)")} END,
          CASE WHEN o_orderkey % 4 = 0 THEN {patch(7, "'lib/c.py'", "renamed", "'@@ -1 +1 @@\\n-x\\n+y'", "'src/d.py'")} END)))""",
    )


@query("apply_patch_chains", f"""SELECT 'i' || {K} AS instance_id, CASE WHEN {K} % 3 = 0 THEN 'lib/c.py' ELSE 'src/c.py' END AS path,
   'ONE' || chr(10) || {K} || chr(10) || 'two' || chr(10) || '3' || chr(10) AS content FROM orders
 UNION ALL SELECT 'i' || {K}, 'README.md', '# ' || {K} FROM orders
 UNION ALL SELECT 'i' || {K}, CASE WHEN {K} % 3 = 0 THEN 'src/d.py' ELSE 'lib/c.py' END,
   CASE WHEN {K} % 3 = 0 THEN 'x' ELSE 'y' || chr(10) END FROM orders WHERE {K} % 4 = 0
 UNION ALL SELECT 'i' || {K}, 'new.py', 'v' || chr(10) || {K} FROM orders WHERE {K} % 5 <> 0""")
def _(spark, sf):
    after, _status = diffs.apply_hunks(chain_files(spark, sf), chain_patches(spark, sf))
    return after


@query("apply_patch_chains_status", f"""SELECT 'i' || {K} AS instance_id, pos, CASE pos WHEN 0 THEN 'src/c.py' WHEN 1 THEN 'lib/c.py'
   WHEN 2 THEN CASE WHEN {K} % 3 = 0 THEN 'lib/c.py' ELSE 'src/c.py' END WHEN 3 THEN 'src/c.py' WHEN 7 THEN 'lib/c.py' ELSE 'new.py' END AS filename,
   CASE pos WHEN 1 THEN 'renamed' WHEN 4 THEN 'added' WHEN 6 THEN 'removed' WHEN 7 THEN 'renamed' ELSE 'modified' END AS status,
   pos <> 3 AND NOT (pos = 7 AND {K} % 3 = 0) AS ok
 FROM orders, (SELECT unnest(range(8))::INT AS pos) p
 WHERE (pos <> 1 OR {K} % 3 = 0) AND (pos <> 6 OR {K} % 5 = 0) AND (pos <> 7 OR {K} % 4 = 0)""")
def _(spark, sf):
    _after, status = diffs.apply_hunks(chain_files(spark, sf), chain_patches(spark, sf))
    return status


# Python sources of parts: which elements are there before and after, and which differ.
P = "p_partkey"
ELEMENTS = f"""side AS (SELECT {P} AS p, 'p' || {P} AS instance_id, 'tests/test_' || p_size || '.py' AS path, s
    FROM part, (VALUES ('before'), ('after')) AS v(s) WHERE s = 'before' OR {P} % 7 <> 0),
  elements AS (SELECT side.*, e.kind, e.name FROM side, (VALUES
     ('class', 'TestA'), ('method', 'TestA.test_m'), ('method', 'TestA.helper'), ('function', 'test_f'),
     ('function', 'inner'), ('function', 'cond'), ('function', 'gone'), ('function', 'test_new')) AS e(kind, name)
   WHERE (name <> 'gone' OR s = 'before' OR p % 5 <> 0) AND (name <> 'test_new' OR s = 'after' AND p % 3 = 0)),
  names AS (SELECT p, instance_id, path, kind, name, bool_or(s = 'before') AS b, bool_or(s = 'after') AS a,
     p % 2 = 1 AND name IN ('TestA', 'TestA.test_m') AS edited FROM elements GROUP BY ALL)"""
CHANGES = f"""{ELEMENTS}, changes AS (SELECT instance_id, path, name,
   CASE WHEN NOT a THEN 'deleted' WHEN NOT b THEN 'added' ELSE 'modified' END AS change_type, kind AS code_type
   FROM names WHERE NOT a OR NOT b OR edited)"""
PYTEST = "(code_type = 'function' AND name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE 'Test%.test\\_%' ESCAPE '\\')"


def sources(spark, sf, side):
    return carriers.code_pairs(spark, sf).select("instance_id", "path", F.col(side).alias("content"))


def both_sides(spark, sf):
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("content")) for s in ("before", "after")])
    return carriers.code_pairs(spark, sf).select("instance_id", "path", F.inline(sides))


def symbol_changes(spark, sf):
    before, after = (symbols.parse_code_elements(sources(spark, sf, s)) for s in ("before", "after"))
    return symbols.diff_code_elements(before, after)


CODE = "'import os' || chr(10) || 'class TestA:' || chr(10) || 'def test_m(self):' || chr(10) || 'return ' || p_size"
MORE_CODE = """chr(10) || 'async def helper(self):' || chr(10) || 'pass' || chr(10) || 'def test_f():' || chr(10) || 'def inner():'
  || chr(10) || 'return 1' || chr(10) || 'return inner' || chr(10) || 'if os:' || chr(10) || 'def cond():' || chr(10) || 'pass'"""
GONE = "chr(10) || 'def gone():' || chr(10) || 'pass'"


@query("normalise_code", f"""SELECT 'p' || {P} AS instance_id, 'before' AS side, {CODE} || {MORE_CODE} || {GONE} AS code FROM part
 UNION ALL SELECT 'p' || {P}, 'after', CASE WHEN {P} % 7 = 0 THEN 'def (:' ELSE {CODE} || CASE WHEN {P} % 2 = 1 THEN ' + 1' ELSE '' END
   || {MORE_CODE} || CASE WHEN {P} % 5 = 0 THEN '' ELSE {GONE} END
   || CASE WHEN {P} % 3 = 0 THEN chr(10) || 'def test_new():' || chr(10) || 'pass' ELSE '' END END FROM part""")
def _(spark, sf):
    return both_sides(spark, sf).select("instance_id", "side", text.normalise_code(F.col("content")).alias("code"))


DEFINITIONS = f"""defs AS (SELECT 'p' || {P} AS instance_id, 'tests/test_' || p_size || '.py' AS path, {P} AS p, s, n
  FROM part, (VALUES ('before'), ('after')) AS v(s), (VALUES ('TestA'), ('TestA.test_m'), ('test_f'),
    ('test_f.inner'), ('gone'), ('test_new')) AS d(n)
  WHERE (s = 'before' OR {P} % 7 <> 0) AND (n <> 'gone' OR s = 'before' OR {P} % 5 <> 0)
    AND (n <> 'test_new' OR s = 'after' AND {P} % 3 = 0))"""


@query("extract_definitions", f"WITH {DEFINITIONS} SELECT instance_id, path, s AS side, n AS qualname FROM defs")
def _(spark, sf):
    return symbols.extract_definitions(both_sides(spark, sf))


@query("parse_code_elements", f"WITH {ELEMENTS} SELECT instance_id, path, s AS side, kind, name FROM elements")
def _(spark, sf):
    return symbols.parse_code_elements(both_sides(spark, sf)).drop("body_hash")


@query("diff_definitions", f"""WITH {DEFINITIONS} SELECT instance_id, path, n AS qualname,
  CASE WHEN bool_or(s = 'after') THEN 'added' ELSE 'deleted' END AS change FROM defs GROUP BY 1, 2, 3
  HAVING count(*) = 1""")
def _(spark, sf):
    before, after = (symbols.extract_definitions(sources(spark, sf, s)) for s in ("before", "after"))
    return symbols.diff_definitions(before, after)


@query("only_modified", f"""SELECT 'p' || {P} AS instance_id, 'tests/test_' || p_size || '.py' AS path,
  {P} % 7 <> 0 AND {P} % 5 <> 0 AND {P} % 3 <> 0 AS only_modified FROM part""")
def _(spark, sf):
    before, after = (symbols.extract_definitions(sources(spark, sf, s)) for s in ("before", "after"))
    return symbols.only_modified(carriers.code_pairs(spark, sf), symbols.diff_definitions(before, after))


@query("diff_code_elements", f"WITH {CHANGES} SELECT * FROM changes")
def _(spark, sf):
    return symbol_changes(spark, sf)


@query("modified_elements", f"WITH {CHANGES} SELECT instance_id, path, code_type AS kind, name FROM changes WHERE change_type = 'modified'")
def _(spark, sf):
    before, after = (symbols.parse_code_elements(sources(spark, sf, s)) for s in ("before", "after"))
    return symbols.modified_elements(before, after)


@query("filter_pytest_changes", f"WITH {CHANGES} SELECT * FROM changes WHERE {PYTEST}")
def _(spark, sf):
    return symbols.filter_pytest_changes(symbol_changes(spark, sf))


@query("build_test_selectors", f"""WITH {CHANGES} SELECT instance_id, path || '::' || replace(name, '.', '::') AS selector
 FROM changes WHERE change_type <> 'deleted' AND code_type <> 'class'""")
def _(spark, sf):
    from ..operators.testlogs import build_test_selectors

    return build_test_selectors(symbol_changes(spark, sf)).select("instance_id", "selector")


@query("skip_unchanged_specs", f"""WITH {CHANGES}, c AS (SELECT DISTINCT instance_id FROM changes WHERE {PYTEST})
 SELECT 'p' || {P} AS instance_id, 'p' || {P} NOT IN (SELECT instance_id FROM c) AS processed FROM part""")
def _(spark, sf):
    from ..operators.labels import skip_unchanged_specs

    specs = carriers.code_pairs(spark, sf).select("instance_id", F.lit(False).alias("processed"))
    run, skipped = skip_unchanged_specs(specs, symbols.filter_pytest_changes(symbol_changes(spark, sf)))
    return run.unionByName(skipped)


@query("pair_before_after", r"""SELECT 'p' || p_partkey AS instance_id, 'tests/test_' || p_size || '.py' AS path,
  CASE WHEN p_size <= 10 THEN '' ELSE 'old ' || p_partkey END AS before,
  CASE WHEN p_size > 40 THEN '' ELSE 'new ' || p_partkey END AS after FROM part WHERE p_type <> 'ECONOMY'""")
def _(spark, sf):
    base = carriers.table(spark, sf, "part").selectExpr(
        "concat('p', p_partkey) AS instance_id", "p_partkey", "p_size",
        "concat('tests/test_', p_size, CASE WHEN p_type = 'ECONOMY' THEN '.md' ELSE '.py' END) AS path")
    return symbols.pair_before_after(
        base, base.where("p_size > 10").withColumn("content", F.expr("concat('old ', p_partkey)")),
        base.where("p_size <= 40").withColumn("content", F.expr("concat('new ', p_partkey)")))


@query("gate_pr", f"""WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS test_files,
   count(*) FILTER (WHERE l_returnflag = 'A' OR l_returnflag = 'R' AND l_linestatus = 'O') AS source_files,
   bool_or((l_returnflag = 'A' OR l_returnflag = 'R' AND l_linestatus = 'O') AND CASE l_linenumber % 4
     WHEN 0 THEN l_partkey % 3 = 0 WHEN 1 THEN l_partkey % 6 = 0 OR l_partkey % 5 = 0
     WHEN 2 THEN l_partkey % 3 = 0 AND l_partkey % 5 > 0 ELSE false END) AS broken
   FROM lineitem GROUP BY 1)
 SELECT CAST(l_orderkey AS VARCHAR) AS pr_number, test_files, source_files, reason IS NULL AS keep, reason FROM (
   SELECT *, CASE WHEN test_files = 0 THEN 'no test files' WHEN source_files = 0 THEN 'no source files'
     WHEN broken THEN 'definitions changed' WHEN l_orderkey % 13 = 0 THEN 'no description' END AS reason FROM g)""")
def _(spark, sf):
    # p % 3 = 0: sources define f; p % 6 = 0: the head also defines g; p % 5 = 0: no base text
    changes = carriers.file_changes(spark, sf).withColumn("repo", F.lit("o/r"))
    p = "cast(regexp_extract(filename, '_([0-9]+)[.]py$', 1) AS int)"
    python = changes.where("filename LIKE '%.py'").selectExpr("repo", "pr_number", "filename AS path", f"{p} AS p").distinct()
    f = "CASE WHEN p % 3 = 0 THEN 'def f():\\n    pass\\n' ELSE 'x = 1\\n' END"
    contents = python.selectExpr(
        "repo", "pr_number", "path",
        f"""explode(array(
          named_struct('side', 'base', 'content', CASE WHEN p % 5 > 0 THEN {f} END),
          named_struct('side', 'head', 'content',
            concat({f}, CASE WHEN p % 6 = 0 THEN 'def g():\\n    pass\\n' ELSE '' END)))) AS c""",
    ).select("repo", "pr_number", "path", "c.*")
    described = carriers.table(spark, sf, "orders").selectExpr(
        "'o/r' AS repo", "cast(o_orderkey AS string) AS pr_number",
        "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'told' END AS description")
    return symbols.gate_pr(changes, contents, described).drop("repo")


# The results document of an order, flattened: entry k, feature i, pull request j.
FLAT = f"""flat AS (SELECT {K} AS k, o_custkey, i, j, CASE WHEN {K} % 19 = 0 THEN '' ELSE {REPO} END AS repo,
   'v' || ({K} % 5) AS version, CASE WHEN {K} % 29 > 0 THEN CAST({K} % 4 + j AS VARCHAR) END AS pr_number,
   CASE WHEN {K} % 23 <> 0 THEN 's' || {K} || '-' || i || '-' || j ELSE '' END AS base_commit,
   'd' || {K} || '-' || i || '-' || j AS problem_statement
  FROM orders, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)
  WHERE (i = 0 OR {K} % 3 > 0) AND (j = 0 OR {K} % 2 = 1)),
 good AS (SELECT * FROM flat WHERE repo <> '' AND pr_number IS NOT NULL AND base_commit <> '')"""


def flat(spark, sf):
    return transform.flatten_results(carriers.results_document(spark, sf))


def instances(spark, sf):
    kept, _rejected = transform.drop_incomplete_entries(flat(spark, sf))
    return transform.build_instances(kept)


@query("flatten_results", f"""WITH {FLAT} SELECT k AS entry_pos, i AS feature_pos, j AS pr_pos, repo, version,
  pr_number, base_commit, problem_statement FROM flat""")
def _(spark, sf):
    return flat(spark, sf).select(
        *transform.POSITION, "repo", "version", "pr_number", "base_commit", "problem_statement")


@query("drop_incomplete_entries", f"""WITH {FLAT} SELECT k AS entry_pos, i AS feature_pos, j AS pr_pos,
  CASE WHEN repo = '' THEN 'no repository' WHEN pr_number IS NULL THEN 'no pull request number'
    WHEN base_commit = '' THEN 'no base commit' END AS reason FROM flat""")
def _(spark, sf):
    kept, rejected = transform.drop_incomplete_entries(flat(spark, sf))
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select(
        *transform.POSITION, "reason")


INSTANCE = """replace(repo, '/', '__') || '-' || pr_number"""


@query("make_instance_id", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, 'o' || (o_custkey % 7) AS org,
  CAST(k % 4 + j AS BIGINT) AS number FROM good""")
def _(spark, sf):
    return instances(spark, sf).select("instance_id", "org", "number")


@query("split_file_changes", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id, base_commit,
  'src/m_' || j || '.py|null' AS patch, 'tests/test_' || j || '.py' AS test_patch FROM good""")
def _(spark, sf):
    def names(column):
        return F.array_join(F.transform(column, lambda c: F.coalesce(c["filename"], F.lit("null"))), "|")

    return instances(spark, sf).select(
        "instance_id", "base_commit", names("patch").alias("patch"), names("test_patch").alias("test_patch"))


@query("dedup_keep_last", f"""WITH {FLAT} SELECT {INSTANCE} AS instance_id,
  arg_max(base_commit, [k, i, j]) AS base_commit, arg_max(problem_statement, [k, i, j]) AS problem_statement,
  (min([k, i, j]))[1] AS first_entry, (min([k, i, j]))[2]::INT AS first_feature FROM good GROUP BY 1""")
def _(spark, sf):
    kept = transform.dedup_keep_last(instances(spark, sf))
    return kept.select(
        "instance_id", "base_commit", "problem_statement", F.col("pos.entry_pos").alias("first_entry"),
        F.col("pos.feature_pos").alias("first_feature"))


@query("derive_spec", """SELECT 'i' || o_orderkey AS instance_id, 'r' || o_custkey AS repo_name,
  CAST(o_orderkey AS VARCHAR) AS number, o_orderkey % 3 = 0 AS processed FROM orders""")
def _(spark, sf):
    return transform.derive_spec(carriers.specs(spark, sf)).select(
        "instance_id", "repo_name", "number", "processed")


@query("file_membership", f"""SELECT 'i' || l_orderkey AS instance_id, {NAME} AS filename,
  coalesce(l_returnflag = 'N' AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p_size > 25), false) AS is_test
 FROM lineitem l""")
def _(spark, sf):
    changes = carriers.file_changes(spark, sf).select("instance_id", "filename")
    tests = carriers.table(spark, sf, "part").where("p_size > 25").selectExpr(
        "concat('Tests/test_', p_partkey, '.py') AS filename")
    test, source = transform.file_membership(changes, tests, keys=())
    return test.withColumn("is_test", F.lit(True)).unionByName(source.withColumn("is_test", F.lit(False)))


@query("nest_release_results", f"""SELECT {REPO} AS repo, 'v' || (o_orderkey % 5) AS tag, o_orderkey // 500 AS chunk,
  string_agg('adds ' || o_orderkey, '|' ORDER BY o_orderkey) AS features,
  CASE WHEN (o_orderkey % 5) > 0 THEN 'at ' || (o_orderkey % 5) END AS analyzed_at
 FROM orders GROUP BY ALL""")
def _(spark, sf):
    feature = carriers.features(spark, sf).withColumn("feature_detailed_description", F.lit("x"))
    analyses = feature.where("tag <> 'v0'").selectExpr(
        "repo", "tag", "concat('at ', substring(tag, 2)) AS analyzed_at").distinct()
    nested = transform.nest_release_results(feature, analyses, size=500)
    names = F.transform("enhanced_new_features", lambda f: f["description"])
    return nested.select("repo", "tag", "chunk", F.array_join(names, "|").alias("features"), "analyzed_at")


@query("drop_releases_without_features", f"""SELECT o_orderkey AS pos FROM orders o
 WHERE EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderkey % 4 = 0
   AND f.o_orderkey % 5 = o.o_orderkey % 5)""")
def _(spark, sf):
    features = carriers.features(spark, sf)
    return transform.drop_releases_without_features(
        features, features.where("feature_type = 'new_feature'")).select("pos")


@query("preview_results", f"""SELECT {K} AS pos, CASE WHEN {K} % 19 = 0 THEN '' ELSE {REPO} END AS repository,
  'v' || ({K} % 5) AS release, i AS feature_pos, 'f' || {K} || '-' || i || '...' AS description,
  CAST(1 + {K} % 2 AS INT) AS pr_count, substr(repeat('long ' || {K} || ' ', 20), 1, 150) || '...' AS detailed_description
 FROM (SELECT * FROM orders ORDER BY {K} LIMIT 5), (VALUES (0), (1)) AS a(i) WHERE i = 0 OR {K} % 3 > 0""")
def _(spark, sf):
    return transform.preview_results(carriers.results_document(spark, sf))


# Prompts and replies.
@query("truncate_readme", """SELECT doc_id, CASE WHEN trim(text) = '' THEN '' ELSE
  'Repository Context (README):' || chr(10) || substr(text, 1, 2000)
  || CASE WHEN length(text) > 2000 THEN '...(truncated)' ELSE '' END || chr(10) || chr(10) || '---' || chr(10) END AS block
 FROM documents""")
def _(spark, sf):
    return carriers.table(spark, sf, "documents").select(
        "doc_id", text.truncate_readme(F.col("text")).alias("block"))


@query("render_release_prompt", """SELECT conv_id || '#' || turn AS prompt_key,
  'Sort the changes of release ' || turn || '.' || chr(10) || text AS prompt FROM conversations""")
def _(spark, sf):
    rows = carriers.table(spark, sf, "conversations").selectExpr(
        "cast(conv_id AS string) AS repo", "cast(turn AS string) AS tag_name", "text AS body",
        "cast(NULL AS string) AS readme")
    return prompts.render_release_prompt(rows)


# All files and whole patches.
WHOLE_SUMMARY = f"""'- src/a_' || {K} || '.py (modified): +' || ({K} % 4) || '/-1' || chr(10) || '  @@ -1,2 +1,'
  || CASE WHEN {K} % 10 = 0 THEN 9 ELSE 1 + {K} % 4 END || ' @@' || chr(10) || ' ctx' || chr(10) || '-old'
  || repeat(chr(10) || '+new', {K} % 4) || chr(10) || '...'
  || CASE {K} % 3 WHEN 0 THEN chr(10) || '- docs/n_' || {K} || '.md (renamed): +0/-0'
       WHEN 1 THEN chr(10) || '- old/r_' || {K} || '.py (removed): +0/-1' || chr(10) || '  @@ -1 +0,0 @@' || chr(10) || '-gone...'
       ELSE '' END"""


ALL_SUMMARIES = f"SELECT 'i' || {K} AS instance_id, {WHOLE_SUMMARY} AS summary FROM orders"
ALL_PR_PROMPTS = f"""SELECT 'i' || {K} || '#7' AS prompt_key, 'Feature: F' || chr(10) || 'Title: T' || chr(10)
  || chr(10) || {WHOLE_SUMMARY} AS prompt FROM orders"""
ALL_PR_NUMBERS = f"""SELECT {K} AS pos, x AS link_pos, CAST(({K} + x) % 100 AS VARCHAR) AS pr_number
 FROM orders, (VALUES (0), (1)) AS v(x) WHERE x < {K} % 3
 UNION ALL SELECT {K}, {K} % 3, NULL FROM orders WHERE {K} % 7 = 0"""


@query("summarise_file_changes", ALL_SUMMARIES)
@query("summarise_all_file_changes", ALL_SUMMARIES)
def _(spark, sf):
    return carriers.patch_lists(spark, sf).select("instance_id", prompts.summarise_file_changes(F.col("patches")).alias("summary"))


@query("render_pr_prompt", ALL_PR_PROMPTS)
@query("render_pr_prompt_of_all_files", ALL_PR_PROMPTS)
def _(spark, sf):
    rows = carriers.patch_lists(spark, sf).select(
        F.col("instance_id").alias("repo"), F.lit("7").alias("pr_number"), F.lit("F").alias("feature_description"),
        F.lit("T").alias("title"), F.lit(None).cast("string").alias("body"), F.col("patches").alias("file_changes"))
    return prompts.render_pr_prompt(rows)


@query("extract_pr_number", ALL_PR_NUMBERS)
@query("extract_pr_numbers", ALL_PR_NUMBERS)
def _(spark, sf):
    links = carriers.features(spark, sf).select("pos", F.posexplode("pr_links").alias("link_pos", "_link"))
    return links.select("pos", "link_pos", text.extract_pr_number(F.col("_link")).alias("pr_number"))


# Pull requests of every repository, found by the links of every feature.
@query("render_feature_prompt", f"""WITH l AS (SELECT {K} AS k, o_custkey AS c, x, ({K} + x) % 100 AS n, {REPO} AS repo FROM orders,
   (VALUES (0), (1)) AS v(x) WHERE x < {K} % 3),
 p AS (SELECT k, repo, string_agg(chr(10) || 'PR #' || n || ': T' || c || '-' || n || chr(10) || '- Status: '
     || CASE WHEN n % 2 = 0 THEN 'closed (merged: True)' ELSE 'open (merged: False)' END || chr(10) || '- Files changed: ' || (n % 5)
     || chr(10) || '- User benefits: ' || CASE WHEN n % 11 = 0 THEN '' ELSE 'D' || c || '-' || n END || chr(10), chr(10) ORDER BY x) AS block
   FROM l WHERE n % 3 > 0 AND c IN (SELECT c_custkey FROM customer) GROUP BY k, repo)
 SELECT repo || '#v' || (k % 5) || '#' || kind || '#' || k AS prompt_key, kind || ': adds ' || k || chr(10) || block AS prompt
 FROM (SELECT *, ['new_feature', 'improvement', 'bug_fix', 'other'][k % 4 + 1] AS kind FROM p)""")
def _(spark, sf):
    number = F.col("pr_number").cast("int")
    known = carriers.pr_analyses(spark, sf).select(
        "repo", "pr_number", F.concat(F.lit("T"), F.split("repo", "/r")[1], F.lit("-"), "pr_number").alias("title"),
        F.when(number % 2 == 0, "closed").otherwise("open").alias("state"), (number % 2 == 0).alias("merged"), (number % 5).alias("files"),
        "detailed_description")
    return prompts.render_feature_prompt(prompts.with_prs(carriers.features(spark, sf), known))


@query("extract_pr_refs", f"""SELECT {K} AS pos, ref_pos, pr_id FROM (
  SELECT {K}, 0 AS ref_pos, CAST({K} AS VARCHAR) AS pr_id FROM orders UNION ALL SELECT {K}, 1, CAST({K} + 1 AS VARCHAR) FROM orders
  UNION ALL SELECT {K}, 2, CAST({K} + 2 AS VARCHAR) FROM orders UNION ALL SELECT {K}, 3, CAST({K} + 3 AS VARCHAR) FROM orders)""")
def _(spark, sf):
    rows = carriers.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS pos",
        """concat('* Adds 12 things (#', o_orderkey, ')\n* See PR #', o_orderkey + 1, ', pr', o_orderkey + 2,
                  '\n* pull ', o_orderkey + 3, ' and #', o_orderkey, ' in v1.2') AS body""")
    return prompts.extract_pr_refs(rows).select("pos", "ref_pos", "pr_id")


@query("extract_pr_refs_in_text", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text,
   '(?i)(?:#|\bPR\s*#?|\bpull\s+#?)([0-9]+)', 1) AS refs FROM documents)
 SELECT doc_id, count(DISTINCT r) AS n FROM (SELECT doc_id, unnest(refs) AS r FROM t) GROUP BY 1""")
def _(spark, sf):
    refs = prompts.extract_pr_refs(carriers.table(spark, sf, "documents"), "text")
    return refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("build_pr_links", f"""SELECT {K} AS pos, 'https://h/' || {REPO} || '/pull/' || {K} || '|https://h/' || {REPO}
  || '/pull/7' AS links FROM orders""")
def _(spark, sf):
    links = text.build_pr_links(F.col("repo"), F.array(F.col("pos").cast("string"), F.lit("7")), "https://h")
    return carriers.releases(spark, sf).select("pos", F.array_join(links, "|").alias("links"))


@query("format_cutoff_date", f"""SELECT {K} AS pos, CASE {K} % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN 'on ' || {K} ELSE '' END AS day FROM orders""")
def _(spark, sf):
    rows = carriers.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS pos",
        """CASE o_orderkey % 3 WHEN 0 THEN concat(date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')
             WHEN 1 THEN concat('on ', o_orderkey) END AS t""")
    return rows.select("pos", text.format_cutoff_date(F.col("t")).alias("day"))


# Replies: every order answers with up to four lists; some are wrapped, empty or broken.
REPLY = r"""CASE WHEN o_orderkey % 11 = 0 THEN 'no json' WHEN o_orderkey % 13 = 0 THEN '{"new_features": ['
  WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Here:\n```{"new_features": [{"description": "n', o_orderkey,
  '", "pr_ids": [', o_orderkey, ', "x7"]}, {"pr_ids": ["1"]}], "bug_fixes": [{"description": "b\\"q"}]',
  CASE WHEN o_orderkey % 2 = 0 THEN ', "other_changes": []' ELSE '' END, '}``` done') END"""


def replies(spark, sf):
    return carriers.table(spark, sf, "orders").selectExpr(
        f"concat({carriers.ORDER_REPO}, '#v', o_orderkey) AS prompt_key", f"{REPLY} AS text")


@query("parse_feature_json", f"""WITH g AS (SELECT {REPO} AS repo, 'v' || {K} AS tag, {K} AS k FROM orders
   WHERE {K} % 11 > 0 AND {K} % 13 > 0 AND {K} % 17 > 0)
 SELECT repo, tag, 'new_feature' AS feature_type, 0 AS pos, 'n' || k AS description,
   'https://github.com/' || repo || '/pull/' || k || '|https://github.com/' || repo || '/pull/x7' AS pr_links FROM g
 UNION ALL SELECT repo, tag, 'new_feature', 1, '', 'https://github.com/' || repo || '/pull/1' FROM g
 UNION ALL SELECT repo, tag, 'bug_fix', 0, 'b"q', '' FROM g""")
def _(spark, sf):
    features, _rejected = prompts.parse_feature_json(replies(spark, sf))
    return features.withColumn("pr_links", F.array_join("pr_links", "|"))


@query("rejected_replies", f"""SELECT {REPO} || '#v' || {K} AS prompt_key FROM orders
 WHERE {K} % 11 = 0 OR {K} % 13 = 0""")
def _(spark, sf):
    _features, rejected = prompts.parse_feature_json(replies(spark, sf))
    return rejected.select("prompt_key")


@query("filter_new_features_with_prs", f"""SELECT {K} AS pos FROM orders
 WHERE {K} % 4 = 0 AND ({K} % 3 > 0 OR {K} % 7 = 0)""")
def _(spark, sf):
    return prompts.filter_new_features_with_prs(carriers.features(spark, sf)).select("pos")


@query("attach_responses", f"""SELECT {K} AS pos, CASE WHEN o_orderstatus <> 'F' THEN 'R' || {K} ELSE 'adds ' || {K} END AS response
 FROM orders""")
def _(spark, sf):
    asked = carriers.features(spark, sf).withColumn("prompt_key", F.col("pos").cast("string"))
    given = carriers.table(spark, sf, "orders").where("o_orderstatus <> 'F'").selectExpr(
        "cast(o_orderkey AS string) AS prompt_key", "concat('R', o_orderkey) AS text")
    return prompts.attach_responses(asked, given, "description").select("pos", "response")


@query("enhance_features", f"""WITH l AS (SELECT {K} AS k, o_custkey, x, ({K} + x) % 100 AS n FROM orders,
   (VALUES (0), (1)) AS v(x) WHERE x < {K} % 3),
 m AS (SELECT k, count(*) AS n_prs, string_agg(CAST(n AS VARCHAR), '|' ORDER BY x) AS pr_numbers,
   arg_min(CASE WHEN n % 11 = 0 THEN '' ELSE 'D' || o_custkey || '-' || n END, x) AS first FROM l
   WHERE n % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1)
 SELECT k AS pos, n_prs, pr_numbers, feature_detailed_description FROM (SELECT *, CASE WHEN n_prs = 1 THEN first
   WHEN k % 5 > 0 THEN 'R' || k END AS feature_detailed_description FROM m) WHERE feature_detailed_description <> ''""")
def _(spark, sf):
    features = carriers.features(spark, sf)
    given = features.where("tag <> 'v0'").select(
        "repo", "tag", "feature_type", "pos", F.concat(F.lit("R"), "pos").alias("text"))
    enhanced = prompts.enhance_features(features, carriers.pr_analyses(spark, sf), given)
    return enhanced.select(
        "pos", "n_prs", F.array_join("pr_numbers", "|").alias("pr_numbers"), "feature_detailed_description")


@query("commits_with_default", """SELECT o_orderkey AS pos, 'c' || o_custkey AS base,
  CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS base_message, 's' || o_orderkey AS head, '' AS head_message
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    prs = carriers.table(spark, sf, "orders").selectExpr(
        "'o/r' AS repo", "o_orderkey AS pos", "concat('c', o_custkey) AS base_sha", "concat('s', o_orderkey) AS head_sha")
    known = carriers.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr(
        "'o/r' AS repo", "concat('c', c_custkey) AS sha", "c_name AS message", "'' AS date", "'' AS author")
    found = prompts.commits_with_default(prs, known)
    return found.select(
        "pos", F.col("base_commit.sha").alias("base"), F.col("base_commit.message").alias("base_message"),
        F.col("head_commit.sha").alias("head"), F.col("head_commit.message").alias("head_message"))
