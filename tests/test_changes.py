import ast
import random
import re

from pyspark.sql import functions as F

from gradewright.functions import diffs as columns
from gradewright.operators import diffs, prompts, symbols, transform
from gradewright.schemas import FILE_CHANGES

DIFF = """diff --git a/src/a.py b/src/a.py
index 1..2 100644
--- a/src/a.py
+++ b/src/a.py
@@ -1,3 +1,3 @@ def f():
 one
-two
+2
 three
diff --git a/tests/test_b.py b/tests/test_b.py
new file mode 100644
--- /dev/null
+++ b/tests/test_b.py
@@ -0,0 +1 @@
+x
\\ No newline at end of file
diff --git a/old.md b/new.md
similarity index 100%
rename from old.md
rename to new.md"""


def parse(spark, diff):
    df = spark.createDataFrame([("i", diff)], "instance_id string, diff string")
    return diffs.parse_unified_diff(df)


def test_parse_unified_diff(spark):
    rows = [tuple(r) for r in parse(spark, DIFF).orderBy("pos").collect()]
    assert rows == [
        ("i", 0, "src/a.py", "modified", None, "@@ -1,3 +1,3 @@ def f():\n one\n-two\n+2\n three", False),
        ("i", 1, "tests/test_b.py", "added", None, "@@ -0,0 +1 @@\n+x\n\\ No newline at end of file", True),
        ("i", 2, "new.md", "renamed", "old.md", "", False),
    ]
    assert parse(spark, "no header\n@@ -1 +1 @@").count() == 0
    assert parse(spark, "").count() == 0


def test_round_trip(spark):
    changes = [
        ("a.py", "modified", 1, 1, 2, "@@ -1 +1 @@\n-a\n+b\n\n", None), ("b.py", "added", 1, 0, 1, "@@ -0,0 +1 @@\n+b", None),
        ("c.py", "removed", 0, 1, 1, "@@ -1 +0,0 @@\n-b", None), ("d.py", "renamed", 0, 0, 0, None, "e.py"),
    ]
    df = spark.createDataFrame([("i", changes)], f"instance_id string, p {FILE_CHANGES}")
    text = df.select("instance_id", columns.assemble_diff(F.col("p")).alias("diff"))
    back = [(r.filename, r.status, r.old_filename, r.patch) for r in diffs.parse_unified_diff(text).orderBy("pos").collect()]
    assert back == [("a.py", "modified", None, "@@ -1 +1 @@\n-a\n+b"), ("b.py", "added", None, "@@ -0,0 +1 @@\n+b"),
                    ("c.py", "removed", None, "@@ -1 +0,0 @@\n-b"), ("d.py", "renamed", "e.py", "")]
    none = spark.createDataFrame([(None,), ([],)], f"p {FILE_CHANGES}").select(columns.assemble_diff(F.col("p")))
    assert [r[0] for r in none.collect()] == ["", ""]


def test_validate(spark):
    bad = DIFF.replace("-1,3 +1,3", "-1,3 +1,4")
    df = spark.createDataFrame([("good", DIFF), ("bad", bad), ("odd", DIFF.replace("@@ -0,0 +1 @@", "@@ nothing"))],
                               "instance_id string, diff string")
    failing = diffs.invalid_instances(diffs.validate_diff(df))
    assert {r.instance_id for r in failing.collect()} == {"bad", "odd"}


def unified(old, new):
    import difflib

    lines = list(difflib.unified_diff(old, new, "a/f", "b/f", n=2, lineterm=""))
    return "\n".join(lines[2:])


def test_apply_hunks_equals_the_edit(spark):
    rng = random.Random(3)
    files, patches, want = [], [], {}
    for i in range(60):
        old = [rng.choice("abcde") for _ in range(rng.randint(1, 30))]
        new = [x for x in old if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        key = f"i{i}"
        files.append((key, "f", "\n".join(old) + "\n"))
        patches.append((key, 0, "f", "modified", None, unified(old, new)))
        want[key] = "".join(x + "\n" for x in new)
    f = spark.createDataFrame(files, "instance_id string, path string, content string")
    p = spark.createDataFrame(patches, "instance_id string, pos int, filename string, status string, old_filename string, patch string")
    after, status = diffs.apply_hunks(f, p)
    assert {r.instance_id: r.content for r in after.collect()} == want
    assert all(r.ok for r in status.collect())


def test_apply_hunks_edges(spark):
    f = spark.createDataFrame([("i", "a", "1\n2"), ("i", "gone", "x\n"), ("i", "m", "old\n"), ("i", "stay", "s"), ("i", "there", "t")],
                              "instance_id string, path string, content string")
    rows = [
        ("i", 0, "a", "modified", None, "@@ -2 +2 @@\n-2\n\\ No newline at end of file\n+3"),
        ("i", 1, "gone", "removed", None, "@@ -1 +0,0 @@\n-x"),
        ("i", 2, "n", "renamed", "m", "@@ -1 +1 @@\n-old\n+new"),
        ("i", 3, "there", "added", None, "@@ -0,0 +1 @@\n+t"),
        ("i", 4, "missing", "modified", None, "@@ -1 +1 @@\n-q\n+r"),
        ("i", 5, "fresh", "added", None, "@@ -0,0 +1 @@\n+f\n\\ No newline at end of file"),
    ]
    p = spark.createDataFrame(rows, "instance_id string, pos int, filename string, status string, old_filename string, patch string")
    after, status = diffs.apply_hunks(f, p)
    assert {r.path: r.content for r in after.collect()} == {"a": "1\n3\n", "n": "new\n", "stay": "s", "there": "t", "fresh": "f"}
    assert {r.filename for r in status.collect() if not r.ok} == {"there", "missing"}


def test_a_summary_has_names_and_text_of_every_diff(spark):
    rows = [("i", 3, "c", True), ("i", 0, "a", True), ("i", 1, "b", False), ("j", 0, "x", False), (None, 0, "n", True), ("i", 2, "d", True)]
    applied = spark.createDataFrame(rows, "instance_id string, pos int, filename string, ok boolean")
    texts = spark.createDataFrame([("i", "I"), ("j", "J"), ("none", "no file"), (None, "N")], "instance_id string, diff string")
    found = diffs.patch_application_summary(applied, texts)
    assert found.columns == ["instance_id", "chunk", "total_files_num", "applied_files_num", "applied_files", "patch_content"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "i": (0, 4, 3, ["a", "d", "c"], "I"), "j": (0, 1, 0, [], "J"), "none": (0, 0, 0, [], "no file"), None: (0, 1, 1, ["n"], "N")}
    parts = diffs.patch_application_summary(applied, texts, size=2).where("instance_id = 'i'").orderBy("chunk").collect()
    assert [tuple(r)[1:] for r in parts] == [(0, 4, 3, ["a"], "I"), (1, 4, 3, ["d", "c"], None)]
    assert diffs.patch_application_summary(applied).count() == 3


def test_a_file_is_patched_once(spark):
    f = spark.createDataFrame([("i", "a", "1\n")], FILES)
    results = diffs.apply_hunks(f, spark.createDataFrame([("i", 0, "a", "modified", None, "@@ -1 +1 @@\n-1\n+2")], PATCHES))
    for df, want in zip(results, [("i", "a", "2\n"), ("i", 0, "a", "modified", True)]):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("AS sound") <= 2  # by a column of single patches, and in chains
        assert not any("Filter" in line and "lambdafunction" in line for line in text.split("\n")) and [tuple(r) for r in df.collect()] == [want]


def test_diffs_are_parsed_once_before_all_uses(spark):
    rows = [("i", 0, "a", "modified", None, "@@ -1 +1 @@\n-1\n+2"), ("i", 1, "n", "renamed", "m", "")]
    f = spark.createDataFrame([("i", "a", "1\n"), ("i", "m", "x"), ("i", "two", None), ("i", "two", "t")], FILES)
    after, status = diffs.apply_hunks(f, spark.createDataFrame(rows, PATCHES))
    assert any("/patches-" in file for file in status.inputFiles())
    assert status.where("ok").count() == 2
    want = [("a", "2\n"), ("n", "x"), ("two", "t"), ("two", None)]
    assert sorted(((r.path, r.content) for r in after.collect()), key=str) == sorted(want, key=str)


def test_plain_comparisons_equal_the_patterns(spark):
    ends = ["", "\r", "\n", "\r\n", "\x85", "\u2028", "\u2029", "\x0b", " ", "+", "-", "@@", "@", "\\", "a", "\r\r", "\ra", "+\r"]
    line = F.col("x")
    found = spark.createDataFrame([(e,) for e in ends], "x string").select(
        columns._begins(line, "@@", "+", " ", "-") == line.rlike("^(?:@@|[+ -]|$)"),
        columns._begins(line, " ", "-") == line.rlike("^(?:[ -]|$)"), columns._begins(line, " ", "+") == line.rlike("^(?:[ +]|$)"))
    assert all(all(r) for r in found.collect())


PATCHES = "instance_id string, pos int, filename string, status string, old_filename string, patch string"
FILES = "instance_id string, path string, content string"


def test_patches_of_one_file_build_on_each_other(spark):
    f = spark.createDataFrame([("i", "a.py", "one\ntwo\nthree\n"), ("i", "o", "x\n"), ("i", "both", "1\n"), ("i", "z", "z"), ("j", "a.py", "q")], FILES)
    rows = [
        ("i", 0, "a.py", "modified", None, "@@ -1 +1 @@\n-one\n+ONE"),
        ("i", 7, "a.py", "modified", None, "@@ -3 +3 @@\n-three\n+THREE"),
        ("i", 1, "n", "renamed", "o", ""),
        ("i", 2, "n", "modified", None, "@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file"),
        ("i", 3, "new", "added", None, "@@ -0,0 +1 @@\n+v"),
        ("i", 4, "new", "modified", None, "@@ -1 +1,2 @@\n v\n+w"),
        ("i", 5, "both", "removed", None, "@@ -1 +0,0 @@\n-1"),
        ("i", 6, "both", "added", None, "@@ -0,0 +1 @@\n+2"),
        ("i", 8, "z", "renamed", "n", ""),  # there is a file
        ("i", 9, "a.py", "modified", None, "@@ -1 +1 @@\n-one\n+late"),
    ]
    after, status = diffs.apply_hunks(f, spark.createDataFrame(rows, PATCHES))
    assert {(r.instance_id, r.path): r.content for r in after.collect()} == {
        ("i", "a.py"): "ONE\ntwo\nTHREE\n", ("i", "n"): "y", ("i", "new"): "v\nw\n", ("i", "both"): "2\n", ("i", "z"): "z", ("j", "a.py"): "q"}
    assert {r.pos for r in status.collect() if not r.ok} == {8, 9} and status.count() == len(rows)


def line_by_line(held, patch):
    """One patch on a dict of path to text, by the plainest reading of its hunks; whether it fits."""
    _, _, name, status, old_name, text = patch
    source = old_name if status == "renamed" else name
    if (source in held) == (status == "added") or (status == "renamed" and name != source and name in held):
        return False
    content = held.get(source, "")
    lines, out, at, open_end = content.split("\n"), [], 0, content != "" and not content.endswith("\n")
    if not open_end:
        lines.pop()
    for hunk in re.findall(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@((?:\n(?!@@).*)*)", text):
        start = int(hunk[0]) - (0 if hunk[1] == "0" else 1)
        out, at = out + lines[at:start], start
        for line in hunk[2].split("\n")[1:]:
            if line[:1] in " -":
                if at >= len(lines) or lines[at] != line[1:]:
                    return False
                at += 1
            if line[:1] in " +":
                out.append(line[1:])
    if at == len(lines):
        open_end = "\n\\" in text
    out += lines[at:]
    if status == "removed" and out:
        return False
    held.pop(source, None)
    if status != "removed":
        held[name] = "\n".join(out) + ("" if open_end or not out else "\n")
    return True


def test_chains_equal_line_by_line(spark):
    rng = random.Random(11)
    files, patches, want, fits = [], [], {}, {}
    for i in range(40):
        held = {f"f{k}": "".join(rng.choice("abc") + "\n" for _ in range(rng.randint(1, 9))) for k in range(rng.randint(0, 3))}
        files += [(f"i{i}", p, c) for p, c in held.items()]
        for pos in range(rng.randint(0, 12)):
            status = rng.choice(["modified"] * 5 + ["renamed", "added", "removed"])
            there = sorted(held) if rng.random() < 0.9 else [f"f{k}" for k in range(5)]
            name = rng.choice(there or ["f0"])
            old = held.get(name, "a\n").split("\n")[:-1]
            new = [] if status == "removed" else [x for x in old if rng.random() > 0.2] + [rng.choice("xyz")]
            if status == "added":
                name, old = f"f{rng.randint(0, 5)}", []
            text = unified(old, new) if old != new else ""
            patch = (f"i{i}", pos, f"f{rng.randint(0, 6)}" if status == "renamed" else name, status, name if status == "renamed" else None, text)
            patches.append(patch)
            fits[f"i{i}", pos] = line_by_line(held, patch)
        want |= {(f"i{i}", p): c for p, c in held.items()}
    assert 0.3 < sum(fits.values()) / len(fits) < 0.95
    after, status = diffs.apply_hunks(spark.createDataFrame(files, FILES), spark.createDataFrame(patches, PATCHES).repartition(5))
    assert {(r.instance_id, r.pos): r.ok for r in status.collect()} == fits
    assert {(r.instance_id, r.path): r.content for r in after.collect()} == want


SOURCE = """
class C:
    def m(self):
        def deep():
            pass
    async def n(self):
        pass
    class In:
        def k(self):
            pass
if True:
    def g():
        pass
async def h():
    def inner():
        pass
def top():
    def low():
        class Loc:
            pass
"""


def contents(spark, *sources):
    return spark.createDataFrame([("i", f"p{n}", s) for n, s in enumerate(sources)], "instance_id string, path string, content string")


def test_definitions(spark):
    found = symbols.extract_definitions(contents(spark, SOURCE, "def (:", None, "", "x\0"))
    assert {r.qualname for r in found.collect()} == {
        "C", "C.m", "C.m.deep", "C.In", "C.In.k", "top", "top.low", "top.low.Loc"}


def naive_elements(source):
    """The three name sets by walking the tree once per function."""
    tree = ast.parse(source)
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    functions = [n for n in ast.walk(tree) if isinstance(n, symbols.FUNCTIONS)]
    rows = {("class", c.name) for c in classes}
    rows |= {("method", f"{c.name}.{m.name}") for c in classes for m in c.body if isinstance(m, symbols.FUNCTIONS)}
    return rows | {("function", f.name) for f in functions if not any(f in ast.walk(c) for c in classes)}


def test_elements(spark):
    found = symbols.parse_code_elements(contents(spark, SOURCE))
    assert {(r.kind, r.name) for r in found.collect()} == naive_elements(SOURCE) == {
        ("class", "C"), ("class", "In"), ("class", "Loc"), ("method", "C.m"), ("method", "C.n"), ("method", "In.k"),
        ("function", "g"), ("function", "h"), ("function", "inner"), ("function", "top"), ("function", "low")}


def changes(spark, before, after):
    b, a = (symbols.parse_code_elements(contents(spark, s)) for s in (before, after))
    rows = symbols.diff_code_elements(b, a).collect()
    return {(r.name, r.change_type, r.code_type) for r in rows}


def test_element_changes(spark):
    before = "class A:\n    def x(self):\n        return 1\ndef f():\n    return 1\ndef same():\n    pass\n"
    after = "class A:\n    def x(self):\n        return 2\ndef f():\n  return 1\n\ndef same():\n    pass\ndef new(): pass\n"
    assert changes(spark, before, after) == {
        ("A", "modified", "class"), ("A.x", "modified", "method"), ("new", "added", "function")}
    # a name that came or went as one kind is not also reported as modified
    assert changes(spark, "class T:\n    x = 1\n", "class T:\n    x = 2\ndef T(): pass\n") == {("T", "added", "function")}
    # one modified row for a name of two kinds
    both = "class T:\n    x = {0}\ndef T():\n    return {0}\n"
    assert changes(spark, both.format(1), both.format(2)) == {("T", "modified", "function")}
    assert changes(spark, "def t(): pass", "def (:") == {("t", "deleted", "function")}


def test_pytest_symbols(spark):
    rows = [("test_a", "function"), ("Test_a", "function"), ("TestA.test_b", "method"), ("A.test_b", "method"),
            ("TestA", "class"), ("TestA.helper", "method"), ("test_x", "method")]
    df = spark.createDataFrame([("i", "p", n, "added", k) for n, k in rows],
                               "instance_id string, path string, name string, change_type string, code_type string")
    assert {r.name for r in symbols.filter_pytest_changes(df).collect()} == {"test_a", "TestA.test_b"}


def test_gate(spark):
    src, tst = "src/a.py", "tests/test_a.py"
    files = [
        ("keep", tst, "added"), ("keep", src, "modified"), ("keep", "src/new.py", "added"), ("keep", "README.md", "added"),
        ("notest", src, "modified"), ("nosrc", tst, "modified"), ("nosrc", "x.md", "modified"),
        ("newdef", tst, "modified"), ("newdef", src, "modified"), ("nohead", tst, "modified"), ("nohead", src, "modified"),
        ("added", tst, "added"), ("added", src, "added"), ("mute", tst, "added"), ("mute", src, "renamed"), ("gone", tst, "added"),
        ("gone", src, "removed"),
    ]
    texts = [
        ("keep", src, "base", "def f():\n    1"), ("keep", src, "head", "def f():\n    2"), ("keep", "src/new.py", "head", "X = 1"),
        ("newdef", src, "base", "def f(): 1"), ("newdef", src, "head", "def f(): 1\ndef g(): 2"), ("nohead", src, "base", "x = 1"),
        ("nohead", src, "head", None), ("added", src, "head", "class A: pass"), ("gone", src, "base", "x = 1"),
    ]
    fc = spark.createDataFrame([("r", *f) for f in files], "repo string, pr_number string, filename string, status string")
    ct = spark.createDataFrame([("r", *t) for t in texts], "repo string, pr_number string, path string, side string, content string")
    ds = fc.select("repo", "pr_number").distinct().withColumn("description", F.when(F.col("pr_number") != "mute", "told"))
    got = {r.pr_number: r.reason for r in symbols.gate_pr(fc, ct, ds).collect()}
    assert got == {"keep": None, "notest": "no test files", "nosrc": "no source files", "newdef": "definitions changed",
                   "nohead": "definitions changed", "added": "definitions changed", "mute": "no description", "gone": None}


def test_split_keeps_null_names(spark):
    change = "named_struct('filename', {}, 'status', '', 'additions', 0L, 'deletions', 0L, 'changes', 0L, 'patch', '', 'old_filename', '')"
    files = ", ".join(change.format(n) for n in ("'a.py'", "'tests/test_a.py'", "cast(NULL AS string)"))
    df = spark.sql(f"SELECT array({files}) AS file_changes, array('tests/test_a.py') AS test_files")
    row = transform.split_file_changes(df).first()
    assert [c.filename for c in row.patch] == ["a.py", None]
    assert [c.filename for c in row.test_patch] == ["tests/test_a.py"]


def test_membership_keeps_null_names(spark):
    fc = spark.createDataFrame([("i", "a"), ("i", None), ("i", "t")], "instance_id string, filename string")
    tests = spark.createDataFrame([("i", "t"), ("i", None)], "instance_id string, filename string")
    test, source = transform.file_membership(fc, tests)
    assert [r.filename for r in test.collect()] == ["t"]
    assert {r.filename for r in source.collect()} == {"a", None}


def test_dedup_keep_last(spark):
    df = spark.createDataFrame([("x", 1, "old"), ("y", 2, "y"), ("x", 3, None)], "instance_id string, pos int, v string")
    rows = sorted(tuple(r) for r in transform.dedup_keep_last(df.repartition(3)).collect())
    assert rows == [("x", 1, None), ("y", 2, "y")]


def test_replies(spark):
    rows = [("o/r#v#1", 'ok {"new_features": [{"description": "d", "pr_ids": [1, "2"]}, {}], "other_changes": null} bye'),
            ("o/r#e", ""), ("o/r#n", None), ("o/r#b", "{broken"), ("o/r#p", "plain")]
    df = spark.createDataFrame(rows, "prompt_key string, text string")
    features, rejected = prompts.parse_feature_json(df, "https://h")
    assert [tuple(r) for r in features.orderBy("pos").collect()] == [
        ("o/r", "v#1", "new_feature", 0, "d", ["https://h/o/r/pull/1", "https://h/o/r/pull/2"]),
        ("o/r", "v#1", "new_feature", 1, "", [])]
    assert {r.prompt_key for r in rejected.collect()} == {"o/r#b", "o/r#p"}


def test_only_statements_are_walked(monkeypatch):
    source = """
try:
    def a(): return [x for x in range(3)]
except ValueError:
    def b(): pass
else:
    class C:
        if 1:
            def inner(self): pass
        def m(self):
            with open("x") as f:
                class D:
                    def k(self): pass
finally:
    async def c(): pass
match 1:
    case 1:
        def d(): pass
while 1:
    def a(): return 2
else:
    for _ in ():
        def e(): pass
"""

    def unwanted(node):
        raise AssertionError("walks expressions as well")

    monkeypatch.setattr(ast, "iter_child_nodes", unwanted)
    found = symbols._elements(source)
    names = {kind: [x["name"] for x in found if x["kind"] == kind] for kind in symbols.KINDS}
    assert {k: sorted(v) for k, v in names.items()} == {"function": ["a", "b", "c", "d", "e"], "class": ["C", "D"], "method": ["C.m", "D.k"]}
    first, second = (symbols._elements(f"def a(): return {body}")[0]["body_hash"] for body in ("[x for x in range(3)]", "2"))
    assert next(x["body_hash"] for x in found if x["name"] == "a") == first != second  # the one in ``try`` comes first
