from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from gradewright.functions import paths, text
from gradewright.operators import curation


@pytest.mark.parametrize("tag, want", [
    ("v1.2.3", [1, 2, 3]), ("release-1.2.3", [1, 2, 3]), ("1-2-3", [1, 2, 3]), ("v 1. 2", [1, 2]),
    ("v1.2.3-4", [1, 2, 3, 4]), ("python3-v1.2", [3]), ("nightly", None), ("", None), (None, None),
    ("v20240101000000000001", [20240101000000000001]),
])
def test_extract_version(one, tag, want):
    got = one(text.extract_version, tag)
    assert (None if got is None else [int(x) for x in got]) == want


@pytest.mark.parametrize("tag, kept", [
    ("1.0rc1", False), ("2.0-beta", False), ("march-1.0", False), ("1.0", True), ("v1.0.A2", False),
])
def test_exclude_prerelease(spark, tag, kept):
    df = spark.createDataFrame([(tag,)], "tag_name string")
    assert (curation.exclude_prerelease(df).count() == 1) == kept


@pytest.mark.parametrize("body, kept", [
    ("x" * 50, True), ("x" * 49 + "\n" * 5, False), (None, False), ("\u3000\x1c" + "x" * 50 + "\x85", True),
    (" " * 80, False),
])
def test_min_body(one, body, kept):
    assert one(curation.has_min_body, body) is kept


@pytest.mark.parametrize("stamp, kept", [
    ("2024-06-01T00:00:00Z", True), ("2024-05-31T23:59:59Z", False), ("2024-06-02", False),
    ("2024-06-02T00:00:00", False), ("", False), (None, False), ("soonZ", False),
    ("2024-06-01T01:00:00+02:00", False), ("2024-05-31T23:00:00-02:00", True),
])
def test_min_date(one, stamp, kept):
    assert one(curation.is_since, stamp) is kept


@pytest.mark.parametrize("path, mining, patch", [
    ("tests/test_a.py", True, True), ("contest/foo.py", False, True), ("Tests/conftest.py", True, True),
    ("test_a.py", False, True), ("tests/a.py", False, True), ("spec/x_spec.py", True, False),
    ("src/a.py", False, False), (None, False, False), ("tests/Test_a.py", False, True),
])
def test_path_rules(one, path, mining, patch):
    assert one(paths.is_test_path, path) is mining
    assert one(paths.is_test_patch, path) is patch


@pytest.mark.parametrize("url, want", [("https://x/pull/12", "12"), ("https://x/issues/3", None), (None, None)])
def test_pr_number(one, url, want):
    assert one(text.extract_pr_number, url) == want


@pytest.mark.parametrize("iso, want", [
    ("2025-10-03T16:39:14Z", "2025-10-03"), ("bad", "bad"), (None, ""), ("2025-10-03", "2025-10-03"),
    ("2025-10-03T23:30:00-05:00", "2025-10-03"), ("2025-13-40T00:00:00Z", "2025-13-40T00:00:00Z"),
])
def test_cutoff_date(one, iso, want):
    assert one(text.format_cutoff_date, iso) == want


def test_identity_columns(spark):
    row = spark.createDataFrame([("acme-labs/core", "153575")], "r string, p string").select(
        text.make_instance_id(F.col("r"), F.col("p")), text.org(F.col("r")), text.number(F.col("p"))).first()
    assert tuple(row) == ("acme-labs__core-153575", "acme-labs", 153575)


def test_labels_as_text(one):
    assert one(text.encode_test_list, ["b", "a", "b"], "array<string>") == "a, b"
    assert one(text.encode_test_list, [], "array<string>") is None
    assert one(text.decode_test_list, "a, b") == ["a", "b"]
    assert one(text.decode_test_list, "") == [] and one(text.decode_test_list, None) == []


def test_pr_references(one):
    found = one(text.pr_references, "Adds 3 (#101), PR #456, PR456, pull 789; pull #12 apr 9 #101")
    assert found == ["101", "456", "789", "12"]


def test_readme_block(one):
    assert one(text.truncate_readme, " \n\t") == "" and one(text.truncate_readme, None) == ""
    assert one(text.truncate_readme, "é" * 2001) == (
        "Repository Context (README):\n" + "é" * 2000 + "...(truncated)\n\n---\n")


@pytest.mark.parametrize("image, want", [
    (("a/B", 7, None), "reg/p/bench_a_b:7"), (("a/b", 7, "x/y:1"), "x/y:1"), (("a/b", 7, "bench_q/z:1"), "reg/p/bench_q/z:1"),
    (("a/b", 7, "plain"), None), ((None, 7, ""), None), (("a/b", 0, None), None),
])
def test_image_name(spark, image, want):
    df = spark.createDataFrame([image], "r string, n bigint, d string")
    assert df.select(text.image_name(F.col("r"), F.col("n"), F.col("d"), "reg/p")).first()[0] == want


def test_template(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    got = df.select(text.render_template("{a}-{b}{{no}} {a}", {"a": F.col("a"), "b": F.col("b"), "no": F.lit("!")}))
    assert got.first()[0] == "x-{!} x"


LINES = st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x1c\x85\u2003é")), max_size=30)


@settings(max_examples=20, deadline=None)
@given(st.lists(LINES, min_size=5, max_size=30))
def test_strip_and_normalise_equal_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select("x", text.strip(F.col("x")), text.normalise_code(F.col("x"))).collect()
    for x, stripped, code in rows:
        assert stripped == x.strip()
        assert code == "\n".join(s for s in (line.strip() for line in x.split("\n")) if s)


def test_topics(spark):
    df = spark.createDataFrame(
        [("a", ["tutorial"]), ("b", ["Tutorial", None]), ("c", None), ("d", []), ("e", [None, "demo"])],
        "full_name string, topics array<string>")
    assert {r.full_name for r in curation.filter_excluded_topics(df).collect()} == {"b", "c", "d"}


def test_versions_rank_by_number_and_input_order(spark):
    rows = [("r", "v1.9", 0), ("r", "v1.10", 1), ("r", "1-10", 2), ("r", "v1", 3), ("r", "v2rc1", 4)]
    df = spark.createDataFrame(rows, "repo string, tag_name string, pos int")
    top = curation.top_releases_per_repo(df, 3).orderBy("rank").collect()
    assert [r.tag_name for r in top] == ["v1.10", "1-10", "v1.9"]
