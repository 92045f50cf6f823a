"""Views that shape the given tables into the inputs of the operators.

Every view is one row-wise projection of one table: whole tables, no grouping, so they grow with
the data and have no hot key of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import dealing, spread
from ..schemas import FILE_CHANGES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_REPO = "concat('o', o_custkey % 7, '/r', o_custkey)"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return files.parquet(sf_dir)


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases_of(table(spark, sf_dir, "orders"))


def releases_of(orders: DataFrame) -> DataFrame:
    """One release per order; versions, pre-release marks, bots and gaps come from its columns."""
    version = "concat(o_orderkey % 5, '.', o_orderkey % 13, '.', o_orderkey % 29)"
    return orders.selectExpr(
        f"{ORDER_REPO} AS repo",
        f"""CASE o_orderkey % 6
              WHEN 0 THEN concat('v', {version})
              WHEN 1 THEN concat('release-', {version})
              WHEN 2 THEN concat(o_orderkey % 5, '-', o_orderkey % 13, ' . ', o_orderkey % 29)
              WHEN 3 THEN concat('v', {version}, 'RC1')
              WHEN 4 THEN concat({version}, '-beta')
              ELSE 'nightly' END AS tag_name""",
        """CASE WHEN o_orderkey % 17 <> 0
             THEN concat(' \t', repeat('x', cast(o_orderkey % 100 AS int)), '\n\n') END AS body""",
        """concat(date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"),
                  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Z' END) AS published_at""",
        """CASE WHEN o_orderpriority <> '1-URGENT' THEN named_struct('login',
             CASE WHEN o_orderpriority = '5-LOW' THEN 'dependabot[bot]'
                  ELSE concat('dev', o_orderkey % 10) END) END AS author""",
        "o_orderkey AS pos",
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('o', c_custkey % 7, '/r', c_custkey) AS full_name",
        "cast(round(c_acctbal * 10) AS bigint) AS stargazers_count",
        """CASE WHEN c_custkey % 13 <> 0 THEN array(
             CASE c_mktsegment WHEN 'MACHINERY' THEN 'tutorial' WHEN 'HOUSEHOLD' THEN 'Tutorial'
                               ELSE lower(c_mktsegment) END,
             CASE WHEN c_custkey % 5 <> 0 THEN 'python' END) END AS topics""",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'Python' ELSE 'Go' END AS language",
        "CASE WHEN c_custkey % 3 <> 0 THEN concat('# ', c_name) END AS readme",
    )


def repo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten listing entries per repository."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('o/r', p_partkey div 10) AS repo",
        """CASE p_partkey % 10
             WHEN 0 THEN CASE WHEN (p_partkey div 10) % 3 = 0 THEN 'docs/README.md' ELSE 'README.md' END
             WHEN 1 THEN concat('src/main_', p_size, '.py')
             WHEN 2 THEN element_at(array('tests/unit/test_a.py', 'Latest/x.py', 'test_root.py',
                                          'docs/tests/conf.txt'), cast((p_partkey div 10) % 4 AS int) + 1)
             WHEN 3 THEN 'build/tests/t.py'
             WHEN 4 THEN concat('.github/workflows/ci', p_size, '.yml')
             WHEN 5 THEN '.github/workflows/sub/x.yml'
             WHEN 6 THEN '.venv/test/x.py'
             WHEN 7 THEN CASE WHEN (p_partkey div 10) % 5 = 0 THEN 'pkg/unit_tests/t.py' ELSE 'setup.py' END
             WHEN 8 THEN CASE WHEN (p_partkey div 10) % 7 = 0 THEN 'notes' ELSE 'Readme.TXT' END
             ELSE 'docs' END AS path""",
        "CASE WHEN p_partkey % 10 = 9 THEN 'dir' ELSE 'file' END AS type",
        "cast(p_partkey % 10 AS int) AS pos",
        "CASE WHEN p_partkey % 3 <> 0 THEN concat('https://h/', p_partkey) END AS download_url",
        "concat('# ', p_name, p_partkey) AS content",
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('o/r', l_suppkey) AS repo",
        "cast(l_orderkey AS string) AS pr_number",
        "concat('i', l_orderkey) AS instance_id",
        "l_linenumber AS pos",
        """CASE WHEN l_returnflag = 'A' THEN concat('src/mod_', l_partkey, '.py')
                WHEN l_returnflag = 'N' THEN concat('Tests/test_', l_partkey, '.py')
                WHEN l_linestatus = 'O' THEN concat('contest/foo_', l_partkey, '.py')
                WHEN l_partkey % 2 = 0 THEN concat('docs/', l_partkey, '.md') END AS filename""",
        """element_at(array('added', 'modified', 'removed', 'renamed'), l_linenumber % 4 + 1)
           AS status""",
        "cast(l_quantity AS bigint) AS additions",
        "cast(l_linenumber AS bigint) AS deletions",
        """cast(l_quantity AS bigint) + l_linenumber
           + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS changes""",
        r"""CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE '@@ -1 +1 @@\n-a\n+b' END AS patch""",
    )


def _change(filename: str, status: str, additions: str, deletions: str, patch: str, old: str) -> str:
    return (
        f"named_struct('filename', {filename}, 'status', {status}, 'additions', cast({additions} AS "
        f"bigint), 'deletions', cast({deletions} AS bigint), 'changes', cast({additions} + "
        f"{deletions} AS bigint), 'patch', {patch}, 'old_filename', {old})"
    )


def patch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three file changes per order: modified, added, and renamed or removed."""
    first = _change(
        "concat('src/a_', o_orderkey, '.py')", "'modified'", "o_orderkey % 4", "1",
        r"""concat('@@ -1,2 +1,', CASE WHEN o_orderkey % 10 = 0 THEN 9 ELSE 1 + o_orderkey % 4 END,
                   ' @@\n ctx\n-old', repeat('\n+new', cast(o_orderkey % 4 AS int)), '\n')""",
        "cast(NULL AS string)",
    )
    second = _change(
        "concat('tests/test_', o_orderkey, '.py')", "'added'", "1", "0",
        r"concat('@@ -0,0 +1 @@\n+x = ', o_orderkey, '\n\\ No newline at end of file')",
        "cast(NULL AS string)",
    )
    renamed = _change(
        "concat('docs/n_', o_orderkey, '.md')", "'renamed'", "0", "0", "cast(NULL AS string)",
        "concat('docs/o_', o_orderkey, '.md')",
    )
    removed = _change(
        "concat('old/r_', o_orderkey, '.py')", "'removed'", "0", "1",
        r"'@@ -1 +0,0 @@\n-gone'", "cast(NULL AS string)",
    )
    third = (
        f"CASE o_orderkey % 3 WHEN 0 THEN array({renamed}) WHEN 1 THEN array({removed}) "
        f"ELSE cast(array() AS {FILE_CHANGES}) END"
    )
    return spread(table(spark, sf_dir, "orders")).selectExpr(
        "concat('i', o_orderkey) AS instance_id",
        f"cast(concat(array({first}, {second}), {third}) AS {FILE_CHANGES}) AS patches",
    )


def deal_by_instance(spark: SparkSession, sf_dir: str) -> tuple[int | str, ...]:
    """How line items are dealt so that an instance's logs are made in one task (see ``layout.dealing``)."""
    return dealing(table(spark, sf_dir, "lineitem").selectExpr("concat('i', l_orderkey) AS instance_id"), ["instance_id"])


def test_logs(spark: SparkSession, sf_dir: str, deal: tuple[int | str, ...] | None = None) -> DataFrame:
    """One log before and one after per line item; ``batch`` orders the logs of an instance.

    ``deal`` (see :func:`deal_by_instance`) deals the line items before the longer logs are made from them.
    """
    name = (
        "concat('tests/t_', l_partkey % 5, '.py::test_', l_suppkey % 4, '[', l_linenumber, '-', "
        "l_partkey, '-', l_suppkey, ']')"
    )
    before = """CASE WHEN l_returnflag = 'A' THEN 'FAILED' WHEN l_returnflag = 'N' THEN 'PASSED'
                     WHEN l_linenumber % 2 = 0 THEN 'SKIPPED' ELSE 'ERROR' END"""
    after = "CASE WHEN l_linestatus = 'F' AND l_linenumber % 4 = 0 THEN 'FAILED' ELSE 'PASSED' END"
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('i', l_orderkey) AS instance_id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus",
    )
    runs = (items.repartition(*deal) if deal else spread(items)).selectExpr(
        "instance_id",
        """((cast(round(l_extendedprice * 100) AS bigint) * 100 + cast(l_quantity AS bigint)) * 4
            + instr('ANR', l_returnflag)) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END
           AS batch""",
        "l_linenumber AS n",
        f"{name} AS name",
        f"""explode(array(named_struct('phase', 'before', 'status', {before}),
                          named_struct('phase', 'after', 'status', {after}))) AS run""",
    )
    esc = "char(27)"
    return runs.selectExpr(
        "instance_id", "batch", "run.phase AS phase",
        rf"""concat('collected 3 items\nPASSED tests/noise.py::early\n',
                    CASE WHEN n = 7 THEN '' ELSE '== short test summary info ==\n' END,
                    CASE WHEN n % 3 = 0 THEN concat('ERROR ', name, '\n') ELSE '' END,
                    '  ', {esc}, '[32m', run.status, {esc}, '[0m ', name, ' - m - x\r\n',
                    'SKIPPED [1] t.py:3: why\nXFAIL t.py::b\n= done =') AS log""",
    )


def label_logs(spark: SparkSession, sf_dir: str, deal: tuple[int | str, ...] | None = None) -> DataFrame:
    """The test logs as runs of both kinds: of the changed tests and of the whole suite."""
    kinds = F.explode(F.array(F.lit("f2p"), F.lit("p2p"))).alias("kind")
    return test_logs(spark, sf_dir, deal).select("*", kinds)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of five test files per order; two of the four tests in each change with three of four orders."""
    body = "transform(sequence(0, 3), t -> concat('def test_', t, '():\\n    return ', {}, '\\n'))"
    new = "CASE WHEN o_orderkey % 4 > 0 AND (t = o_custkey % 4 OR t = (o_custkey + 1) % 4) THEN 1 ELSE 0 END"
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('i', o_orderkey) AS instance_id",
        f"array_join({body.format(0)}, '\\n') AS before", f"array_join({body.format(new)}, '\\n') AS after",
        "explode(array(concat('tests/t_', o_orderkey % 5, '.py'), concat('tests/t_', (o_orderkey + 1) % 5, '.py'))) AS path",
    )


def changed_selectors(spark: SparkSession, sf_dir: str, deal: tuple[int | str, ...] | None = None) -> DataFrame:
    """The tests that ``changed_files`` changes; ``deal`` deals the orders as :func:`test_logs` deals line items."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").selectExpr(
        "concat('i', o_orderkey) AS instance_id", "o_orderkey", "o_custkey")
    return (orders.repartition(*deal) if deal else orders).selectExpr(
        "instance_id",
        "explode(flatten(transform(array(o_orderkey % 5, (o_orderkey + 1) % 5), f -> transform("
        "array(o_custkey % 4, (o_custkey + 1) % 4), t -> concat('tests/t_', f, '.py::test_', t))))) AS selector",
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_results_of(table(spark, sf_dir, "events"))


def eval_results_of(events: DataFrame) -> DataFrame:
    judged = "event_type <> 'error'"
    return events.selectExpr(
        "event_type AS agent",
        "concat('m', user_id % 3) AS model",
        "concat('i', user_id) AS instance_id",
        f"CASE WHEN {judged} THEN value > 20 END AS success_f2p",
        f"CASE WHEN {judged} THEN value > 10 END AS success_p2p",
        f"{judged} AND value > 20 AS success",
        f"CASE WHEN {judged} THEN event_id % 1000 END AS total_tokens",
        "ts AS finished_at",
        "event_id",
    )


def agent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run log per event in the format of its kind; counts come from props and event_id."""
    return spread(table(spark, sf_dir, "events")).selectExpr(
        "event_type AS agent", "concat('e', event_id) AS instance_id",
        "cast(get_json_object(props, '$.k') AS bigint) AS n", "event_id % 100 AS m", "event_id",
    ).selectExpr(
        "agent", "instance_id",
        r"""CASE agent
          WHEN 'click' THEN concat('start\n{"usage": {"input_tokens": 1, "output_tokens": 2}}\n',
            '  {"type": "x", "usage": {"input_tokens": ', n,
            CASE WHEN m % 4 = 0 THEN '' ELSE concat(', "output_tokens": "', m, '"') END,
            '}}\n{broken "usage"}\n{"type": "end"}\n')
          WHEN 'view' THEN concat('{"usage": {"prompt_tokens": ', n,
            ', "completion_tokens": 0, "output_tokens": ', m, '}}', char(13),
            '{"usage": "none", "metrics": {"total_input_tokens": 5}}\n',
            CASE WHEN m % 2 = 0 THEN '{"token_usage": {"input_tokens": 7}, "metrics": {}}' ELSE '{}' END)
          WHEN 'purchase' THEN CASE WHEN m % 5 = 0
            THEN concat('{"stats": {"models": {}, "inputTokens": ', n, ', "output_tokens": "', m, '"}}')
            WHEN m % 5 = 1 THEN concat('{\n "stats": {"models": {"a": {"tokens": {"input": ', n, '}}}}\n}\n')
            ELSE concat('going\n{"stats": {"models": {"a": {"tokens": {"input": ', n,
              ', "candidates": 2, "total": ', n + m, '}}, "b": {"tokens": {"input": 1}}}}}\nbye') END
          WHEN 'signup' THEN concat(char(27), '[1mExecution Summary', char(27), '[0m\n',
            '│ Input Tokens │ 1 │\n', ' │ Input Tokens  │  ', n, ' │\n│ Output Tokens │ ', m, ' │\n')
          ELSE '│ Input Tokens │ 5 │' END AS log""",
    )


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small Python test file per part, before and after a change."""
    head = r"""'import os\n\nclass TestA:\n    def test_m(self):\n        return ', p_size"""
    tail = (
        r"'\n    async def helper(self):\n        pass\n\ndef test_f():\n    def inner():\n"
        r"        return 1\n    return inner\n\nif os:\n    def cond():\n        pass\n'"
    )
    gone = r"'\ndef gone():\n    pass\n'"
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "concat('p', p_partkey) AS instance_id",
        "concat('tests/test_', p_size, '.py') AS path",
        f"concat({head}, {tail}, {gone}) AS before",
        rf"""CASE WHEN p_partkey % 7 = 0 THEN 'def (:'
             ELSE concat({head}, CASE WHEN p_partkey % 2 = 1 THEN ' + 1' ELSE '   ' END, {tail},
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {gone} END,
               CASE WHEN p_partkey % 3 = 0 THEN '\ndef test_new():\n    pass\n' ELSE '' END) END AS after""",
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{ORDER_REPO} AS repo",
        "concat('i', o_orderkey) AS instance_id",
        "o_orderkey AS number",
        "o_orderkey AS pos",
        """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
           ELSE concat('tests/b.py::u, tests/a.py::t', o_orderkey) END AS FAIL_TO_PASS""",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'tests/c.py::p' END AS PASS_TO_PASS",
        "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS processed",
        """CASE o_orderkey % 6 WHEN 0 THEN concat('hub.io/a/b:', o_orderkey % 50)
             WHEN 1 THEN concat('bench_x:', o_orderkey % 50) WHEN 2 THEN 'plain' WHEN 3 THEN ''
             END AS docker_image""",
    )


def results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results entry per order: one or two features with one or two pull requests each."""
    changes = "array({})".format(", ".join([
        _change("concat('src/m_', j, '.py')", "'modified'", "o_orderkey % 9", "1", "'@@ -1 +1 @@'",
                "cast(NULL AS string)"),
        _change("concat('tests/test_', j, '.py')", "'added'", "2", "0", "cast(NULL AS string)",
                "cast(NULL AS string)"),
        _change("cast(NULL AS string)", "'modified'", "0", "0", "''", "cast(NULL AS string)"),
    ]))
    pr = f"""named_struct(
        'pr_number', CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE cast(o_orderkey % 4 + j AS string) END,
        'base_commit', named_struct('sha', CASE WHEN o_orderkey % 23 <> 0
             THEN concat('s', o_orderkey, '-', i, '-', j) ELSE '' END, 'date', '2025-01-01T00:00:00Z'),
        'detailed_description', concat('d', o_orderkey, '-', i, '-', j),
        'file_changes', {changes},
        'test_files', array(concat('tests/test_', j, '.py')),
        'non_test_files', array(concat('src/m_', j, '.py')))"""
    feature = f"""named_struct(
        'feature_type', 'new_feature', 'description', concat('f', o_orderkey, '-', i),
        'feature_detailed_description', repeat(concat('long ', o_orderkey, ' '), 20),
        'pr_analyses', transform(sequence(0, cast(o_orderkey % 2 AS int)), j -> {pr}))"""
    return spread(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey AS pos",
        f"CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE {ORDER_REPO} END AS repository",
        "concat('v', o_orderkey % 5) AS release",
        "'2025-01-02 00:00:00' AS analyzed_at",
        f"""transform(sequence(0, cast(o_orderkey % 3 > 0 AS int)), i -> {feature})
            AS enhanced_new_features""",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per order; its links name up to two pull requests, sometimes another page."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"{ORDER_REPO} AS repo",
        "concat('v', o_orderkey % 5) AS tag",
        """element_at(array('new_feature', 'improvement', 'bug_fix', 'other'),
                      cast(o_orderkey % 4 AS int) + 1) AS feature_type""",
        "o_orderkey AS pos",
        "concat('adds ', o_orderkey) AS description",
        f"""concat(
          transform(slice(array(0, 1), 1, cast(o_orderkey % 3 AS int)),
                    x -> concat('https://h/', {ORDER_REPO}, '/pull/', (o_orderkey + x) % 100)),
          CASE WHEN o_orderkey % 7 = 0 THEN array('https://h/about') ELSE array() END) AS pr_links""",
    )


def pr_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed pull requests of every repository."""
    numbers = spread(table(spark, sf_dir, "customer")).selectExpr(
        "c_custkey", "explode(filter(sequence(0, 99), n -> n % 3 <> 0)) AS n"
    )
    return numbers.selectExpr(
        "concat('o', c_custkey % 7, '/r', c_custkey) AS repo",
        "cast(n AS string) AS pr_number",
        "CASE WHEN n % 11 = 0 THEN '' ELSE concat('D', c_custkey, '-', n) END AS detailed_description",
    )
