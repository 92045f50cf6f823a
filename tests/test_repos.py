from pyspark.sql import functions as F

from gradewright.operators import curation, repos

TREE = "repo string, path string, type string, pos int"


def tree(spark, listing):
    rows = [(repo, path, "dir" if path.endswith("/") else "file", n)
            for repo, paths in listing.items() for n, path in enumerate(paths)]
    df = spark.createDataFrame(rows, TREE)
    return df.withColumn("path", F.regexp_replace("path", "/$", ""))


def test_suites(spark):
    df = tree(spark, {
        "root": ["conftest.py"], "dir": ["tests/", "tests/data/x.json"], "latest": ["Latest/deep/er/a.py"],
        "deep": ["src/tests/test_a.py"], "text": ["test_notes.txt"], "spec": ["specs/a.md", "specs/b_spec.py"]})
    got = {r.repo for r in repos.has_test_suite(df).where("has_tests").collect()}
    assert got == {"root", "latest", "spec"}


def test_suite_folders(spark):
    df = tree(spark, {
        "root": ["tests/a.py", "TEST/", "pkg/test/b.py"], "deep": ["pkg/test/b.py", "build/tests/c.py", ".venv/test/"],
        "ignored": ["build/tests/c.py"], "none": ["a.py", "tests"], "hidden": [".x/unit_tests/a.py", "a/build/Tests/b.py"]})
    got = {}
    for row in repos.detect_test_dirs(df).collect():
        got.setdefault(row.repo, set()).add(row.test_dir)
    assert got == {"root": {"tests", "TEST"}, "deep": {"pkg/test"}, "ignored": {"tests"}, "none": {"tests"},
                   "hidden": {"x/unit_tests", "a/build/Tests"}}


def test_readme_and_workflows(spark):
    df = tree(spark, {"a": ["docs/README.md", "readme.RST", "README.md"], "b": ["README.html"], "c": [".github/workflows/x.yaml"]})
    df = df.withColumns({"content": F.concat(F.lit("of "), "path"), "download_url": F.concat(F.lit("u/"), "path")})
    assert {r.repo: r.readme for r in repos.pick_readme(df).collect()} == {"a": "of readme.RST", "b": "", "c": ""}
    configs = repos.collect_ci_configs(df).collect()
    assert [(r.repo, r.chunk, r.ci_configs) for r in configs] == [
        ("c", 0, {".github/workflows/x.yaml": "u/.github/workflows/x.yaml"})]


def test_rank_range(spark):
    df = spark.range(2000).select(F.concat(F.lit("r"), F.lpad("id", 4, "0")).alias("full_name"), (F.col("id") / 2).cast("bigint").alias("stargazers_count"))
    got = curation.rank_range(df, start=1, end=3).orderBy("rank").collect()
    assert [(r.full_name, r.rank) for r in got] == [("r1998", 1), ("r1999", 2), ("r1996", 3)]
    assert curation.rank_range(df, end=5000).count() == df.count() > 1000


def test_counts_and_totals(spark):
    rows = [("r", "v1", "new_feature"), ("r", "v1", "other"), ("r", "v2", "bug_fix"), ("s", "v1", "improvement")]
    df = spark.createDataFrame(rows, "repo string, tag string, feature_type string")
    counts = {(r.repo, r.is_total): (r.new_features, r.improvements, r.bug_fixes) for r in curation.feature_type_counts(df).collect()}
    assert counts == {("r", 0): (1, 0, 1), ("s", 0): (0, 1, 0), (None, 1): (1, 1, 1)}
    assert tuple(curation.results_metadata(df).first()) == (2, 3, 4)
    assert tuple(curation.results_metadata(df.limit(0)).first()) == (0, 0, 0)


def test_states_of_parts_merge_to_the_whole(spark):
    rows = [(f"r{k % 4}", f"v{k % 3}.{k * 7 % 5}.{k % 2}" if k % 9 else "nightly", k) for k in range(200)] + [("only", "nightly", 900)]
    df = spark.createDataFrame(rows, "repo string, tag_name string, pos long")
    whole = curation.release_state(df, 5)
    parts = [curation.release_state(df.where(f"pos % 3 = {k}"), 5) for k in range(3)]
    merged = curation.merge_release_states(parts[0].union(parts[1]).union(parts[2]), 5)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.collect()))
    assert {r.repo: (r.releases_count, len(r.top)) for r in merged.collect()}["only"] == (1, 0)
