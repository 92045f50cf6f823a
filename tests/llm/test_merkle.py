"""Merkle manifests against hashing by hand."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gradewright.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def rise(nodes, fan):
    """All levels from the nodes up to one."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][k : k + fan]) for k in range(0, len(found[-1]), fan)])
    return found


def steps(levels, index, fan):
    out = []
    for level in levels[:-1]:
        start = index // fan * fan
        out.append((level[start:index], level[index + 1 : start + fan]))
        index //= fan
    return out


def brute(rows, fan, seen):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = rise([leaf(r) for r in groups[source]], fan)
    top = rise([trees[s][-1][0] for s in order], fan)
    out = []
    for number, source in enumerate(order):
        for k, row in enumerate(groups[source]):
            path = steps(trees[source], k, fan) + steps(top, number, fan)
            node = leaf(seen(row))
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*[d for before, after in path for d in before + after])
            out.append((row[0], leaf(row), trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def tampered(row):
    cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
    return (*row[:4], row[4].replace("\n", "")) if cut else row


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_manifest_equals_hashing_by_hand(spark, fan):
    random.seed(fan)
    rows = [(k, random.choice(["a", "a", "a", "é", "", None, f"s{k % 4}"]), "en", k, f"line\n{k % 9}\n" if k % 3 else "flat") for k in range(120)]
    rows += [(5, "a", None, None, None), (5, "a", None, None, None), (None, "a", "x", 1, ""), (-3, "lone", "", 0, "\n"), (None, None, None, None, None)]
    more = spark.createDataFrame([(*r, 1, "clash") for r in rows], f"{DDL}, _tree int, leaf string")
    found = merkle.manifest(more, fan=fan, also={"seen": merkle.without_lines(more)}).withColumn("_folded", merkle.folded(F.col("seen"), F.col("path")))
    got = [
        (r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof, r._folded.hex(), r._folded == r.root)
        for r in found.withColumn("proof", merkle.proof(F.col("path"))).collect()
    ]
    assert sorted(got, key=repr) == brute(rows, fan, tampered)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(1, "s", "en", 2, "ab")], DDL)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.path == [] and r.leaf.hex() == leaf((1, "s", "en", 2, "ab"))
    assert merkle.manifest(one.limit(0)).count() == 0


def test_changed_rows_do_not_verify(spark):
    rows = [(k, "s" if k % 2 else "t", "en", k, f"text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, DDL)
    changed = df.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("text")))
    also = {"seen": merkle.leaf([changed[c] for c in merkle.COLUMNS])}
    found = merkle.manifest(changed, also=also).select("doc_id", "seen")
    kept = merkle.manifest(df).join(found, "doc_id").withColumn("_folded", merkle.folded(F.col("seen"), F.col("path")))
    assert {r.doc_id for r in kept.where("_folded <> root").collect()} == {k for k in range(40) if k % 7 == 0}
