"""Importance resampling against a plain reading of its rules."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.llm import ordering, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = [(tuple(r[:4]), k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    rest = [(tuple(r[:4]), None) for r in rows if not r[4]] + [(tuple(r[:4]), None) for r in able[len(places) :]]
    return sorted(places + rest, key=repr)


@pytest.mark.parametrize(("buckets", "percent", "halvings"), [(10_000, 25, 4), (7, 40, 1), (50, 100, 3), (50, 0, 2)])
def test_resampling_equals_brute_force(spark, buckets, percent, halvings):
    random.seed(4)
    words = ["Alpha", "beta", "Γάμμα", "x9", "--", "it's", "ÉTÉ", "漢字", "a_b"]
    docs = [(k, " ".join(random.choice(words) for _ in range(random.randint(0, 60)))) for k in range(150)]
    docs += [(7, "same words here " * 9)] * 30 + [(None, "beta " * 25), (None, None), (900, ""), (901, "one"), (-5, None)]
    target = ["alpha x9 alpha", "", None, "漢字 it's"]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in docs], "doc_id long, text string, score int, _row string")
    other = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resampling.resample(df, other, percent, 20, buckets, halvings=halvings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((((r.doc_id, r.n_features, r.weight, r.score), r["rank"]) for r in got.collect()), key=repr) == brute(docs, target, buckets, percent, 20)
    empty = resampling.resample(df.limit(0), other.limit(0), percent, 20, buckets)
    assert empty.columns == got.columns and empty.count() == 0


def test_pieces_of_a_long_text_join_up():
    text = " ".join(f"w{k % 9}" if k % 50 else "x" * 300 for k in range(2000)).encode()
    whole = np.sort(np.concatenate([c for _, c in resampling.feature_checksums(text)]))
    parts = list(resampling.feature_checksums(text, piece=64))
    assert len(parts) > 20 and sum(n for n, _ in parts) == 2000
    assert (np.sort(np.concatenate([c for _, c in parts])) == whole).all()
    assert sorted(zlib.crc32(f.encode()) for f in features(text.decode())[1]) == whole.tolist()


@pytest.mark.parametrize("halvings", [1, 4])
def test_cutoff_takes_exactly_the_greatest(spark, halvings):
    random.seed(1)
    rows = [(random.choice([-5, 0, 3, 1 << 62, -(1 << 63)]), random.randint(0, 3), k) for k in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    for k in (0, 1, 57, 199, 200, 300):
        got = df.where(resampling.cutoff(df, [F.col("a"), F.col("b"), F.col("c")], k, halvings)).collect()
        assert sorted(map(tuple, got)) == sorted(sorted(rows)[::-1][:k])


def test_ranked_numbers_rows_by_ranges(spark):
    df = spark.createDataFrame([(k * 37 % 500, "x") for k in range(500)], "v long, more string")
    got = ordering.ranked(df, [F.col("v").desc()], "test-rank")
    assert all(r._rank == 499 - r.v for r in got.collect()) and got.count() == 500
