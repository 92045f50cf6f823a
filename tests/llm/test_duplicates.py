"""Exact and near duplicates, fingerprints and components against brute force."""

import collections
import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash

from gradewright.llm import exact_dedup, fingerprints, simhash
from gradewright.llm.components import components

ROWS = [(1, "a b"), (2, "ab"), (3, None), (4, " "), (None, "a\tb "), (None, "zz"), (5, "x"), (5, "x"), (6, "ab"), (-7, "a b"), (8, "é  "), (9, "é ")]
ROWS += [(100 + i, "hot copies of one text") for i in range(300)] + [(1000 + i, f"w{i} v{i} u{i % 7} t") for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS], "doc_id long, text string, _row_key int, _hash string")


@pytest.mark.parametrize("bounds", [{}, {"depth": 3, "slack": 1, "least": 1}, {"depth": 6, "slack": 1, "least": 4}])
def test_exact_duplicates(docs, bounds):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": [r[1] for r in ROWS]}))
    assert oracle.compare(exact_dedup.exact_duplicates(docs, **bounds), con, exact_dedup.SQL) is None


def test_directory_splits_until_buckets_fit(spark):
    rows = spark.createDataFrame([(v << 60,) for v in [0] * 50 + [1, 2, 3, 4] + [6] * 3], "_hash long")
    cells = {r._cell: (r._bucket >> 32, r._pages) for r in exact_dedup.directory(rows, depth=4, slack=1, least=4).collect()}
    assert cells[0] == (4, 13)  # full depth, pages for what cannot be split
    assert cells[1] == (4, 1) and cells[2] == cells[3] == (3, 1) and cells[4] == cells[6] == (2, 1)


def test_deduplicated_keeps_one_row_of_each_group_with_all_columns(docs):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = collections.Counter(re.sub(r"[ \t-\r]", "", t or "") for _, t in ROWS)
    got = kept.collect()
    assert collections.Counter(re.sub(r"[ \t-\r]", "", r.text or "") for r in got) == collections.Counter(dict.fromkeys(groups, 1))
    assert {r.doc_id for r in got if r.text and r.text.strip() in ("é", "x", "a\tb")} == {8, 5, None}
    assert {r._row_key for r in got} == {1} and exact_dedup.deduplicated(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = np.array(values, "u8")
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(found[i] ^ found[i + 1 :]) <= 3):
            parent[root(i)] = root(i + 1 + int(j))
    return [root(i) for i in range(len(values))]


def signed(v):
    return v - ((v >> 63) << 64)


def test_near_duplicates(spark, docs):
    random.seed(4)
    base = [random.choice("abcdefghij") * 3 + str(k) for k in range(400)]
    rows = list(ROWS)
    for k in range(12):
        words = list(base)
        words[k] = "changed"
        rows.append((5000 + k, " ".join(words).title() if k % 2 else " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [brute_fingerprint(t) for _, t in rows]
    least = {}
    roots = brute_components(prints)
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = sorted(((i, "%016x" % p, least.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
    for dense in (512, 2):
        assert sorted(map(tuple, simhash.near_duplicates(df, dense=dense).collect()), key=repr) == want
    kept = simhash.deduplicated(df.where("doc_id is not null and doc_id <> 5")).collect()
    assert {r.doc_id for r in kept} == {least[r] for (i, _), r in zip(rows, roots) if i not in (None, 5)} - {5} or len(kept) == len({r for (i, _), r in zip(rows, roots) if i not in (None, 5)})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [1, 4, 10_000])
def test_links_give_the_components_of_all_pairs(spark, dense):
    random.seed(3)
    values = set()
    for _ in range(25):
        centre = random.getrandbits(64)
        for _ in range(25):
            v = centre
            for b in random.sample(range(64), random.randint(0, 4)):
                v ^= 1 << b
            values.add(v)
            centre = v if random.random() < 0.3 else centre
    values = sorted(values)
    want = collections.defaultdict(set)
    for v, r in zip(values, brute_components(values)):
        want[r].add(signed(v))
    got = collections.defaultdict(set)
    for r in components(simhash.links(spark.createDataFrame([(signed(v),) for v in values], "_fp long"), dense)).collect():
        got[r.component].add(r.node)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}
    assert all(min(s) == k for k, s in got.items())


def test_long_texts_are_counted_in_runs():
    text = (" ".join(f"w{k % 97}" for k in range(1000))).encode()
    assert simhash.fingerprint(text) == simhash.fingerprint(text, at_once=7) == brute_fingerprint(text.decode())


def kmers(text, k=5):
    hashes = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)))[0] for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not hashes:
        return []
    parts = [tuple(hashes[i : i + k]) for i in range(max(1, len(hashes) - k + 1))]
    return [p for p in parts if len(hashes) < k or min(p) in (p[0], p[-1])] or parts


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, " one two "), (-4, "one two")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(key=lambda r: -r[0])
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited, r = text[: len(text) - len(text) // 3] + after[: len(text) // 3], got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint.split()) == len(kmers(text)) and len(r.edited_fingerprint.split()) == len(kmers(edited))
        assert r.near_edited == pytest.approx(dice(kmers(text), kmers(edited)), abs=1e-3)
        assert r.near_next == pytest.approx(dice(kmers(text), kmers(after)), abs=1e-3)


def test_fingerprints_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "one two three four five six"), (5, "x"), (5, "x"), (7, "")], "doc_id long, text string")
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.doc_id == 7} == {0}
    assert len({(r.fingerprint, r.edited_fingerprint) for r in got if r.n_chars == 1}) == 1
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_texts_with_words_never_have_an_empty_fingerprint(spark):
    random.seed(6)
    rows = [(k, " ".join(f"w{random.randint(0, 10_000)}" for _ in range(5 + k % 4))) for k in range(400)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.fingerprint for r in got) and all(r.edited_fingerprint for r in got)
    assert all(r.near_next == 0 for r in got)
