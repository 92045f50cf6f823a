"""Operator 5: cross-entropy difference of matched n-gram models of words.

A text's events are its word bigrams, from its edge before the first word to its edge behind the last, one per token
(the words and the end). Target and background are models of the same events under one vocabulary, all bigrams of the
corpus by their 64-bit hashes. Target counts come from all documents that are labelled good, background counts from
all documents; the background's are scaled to the target's size (by the bytes of the texts), and both are smoothed
by the same ``PRIOR`` per event, so that an event that neither has seen says nothing. No document meets its own words: its counts
are taken out of both models before it is scored. A document's score is the mean over its tokens of the target's loss
minus the background's, in bits: below zero reads more like the target.

Events are counted within each document first. All events of the corpus have their counts; nothing caps them and nothing
of them reaches the driver but the two sizes and the names of the hot ones. Two ways lead a document's events to their
counts, with equal results. An event that a 65,536th of all rows (of a document and an event) has or more is hot; a task
leaves out only what is too rare in it to hide one, so the list has all of them and at most twice 65,536. Hot events are
counted in each task before they are shuffled, and their counts are broadcast to the documents' rows. Any other event has few rows: they
are shuffled once, to be counted and scored where they meet. These rows go by ranges of the events' hashes, packed by
task and range: events in order as differences, documents by number, bytes of one place together, which compresses.
Texts are read anew rather than stored as events.

Edge cases: a null or empty text has the end as its only token; no target text scores every document by the background
alone; labels that are null or not 1 make no target, a doc_id labelled twice counts once; a null doc_id is scored and never a
target; an empty table gives no row; rows equal in doc_id and text each get a row, and each leaves out one copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query, table, written
from .tokens import runs

PRIOR = 0.5  # events that each model adds to every event
EDGE = 0
COMMON = 65_536
MIX = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
TEXT_BYTES = 4 << 20  # of texts whose events are counted at once
SHARE_BYTES = PACK_BYTES = 4 << 20
RANGE_BYTES = 12 << 20  # of text for each range of events
PACKED = ["_range", "_keys", "_steps", "_places", "_counts"]


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``_good``, whether their doc_id is labelled so; Spark chooses the join by the labels' size."""
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("_good", F.lit(1))
    return rows.join(good, "doc_id", "left").withColumn("_good", F.coalesce("_good", F.lit(0)))


def _cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events of texts in ascending order, each with the place of its text and its count there."""
    import xxhash

    parts = texts.cast(pa.large_binary()).to_pylist()
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), "i8", len(parts)))])
    data = b"".join(parts)
    space = BLANK[np.frombuffer(data, "u1")]
    first = ~space
    first[1:] &= space[:-1]
    inner = cuts[:-1][np.diff(cuts) > 0]
    first[inner] = ~space[inner]
    begins = np.flatnonzero(first)
    # a word goes up to the next one, so white space is taken off before it is hashed
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype("i8")), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w.rstrip(), 42) for w in coded.dictionary.to_pylist()], "u8")[coded.indices.to_numpy()]
    at = np.searchsorted(begins, cuts)
    event = np.insert(hashes, at[:-1], EDGE) * MIX ^ np.insert(hashes, at[1:], EDGE)
    doc = np.repeat(np.arange(len(parts), dtype="i4"), np.diff(at) + 1)
    del space, first, words, coded, hashes
    order = np.argsort(event, kind="stable")
    event, doc = event[order], doc[order]
    new = np.ones(len(event), bool)
    new[1:] = (event[1:] != event[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return event[starts], doc[starts], np.diff(np.append(starts, len(event)))


def _among(events: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which events are among ``some``, which are in order."""
    if not len(some):
        return np.zeros(len(events), bool)
    return some[np.minimum(np.searchsorted(some, events), len(some) - 1)] == events


def hot_events(texts: DataFrame, most: int = COMMON) -> np.ndarray:
    """Events, in order, that a ``most``-th of all rows of a text and an event has or more, all of them; at most
    twice ``most``. What a share of the texts leaves out is less than half of that in it, and so in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, SHARE_BYTES):
            event, rows = np.unique(_cells(batch["text"])[0], return_counts=True)
            often = rows * 2 * most >= rows.sum()
            names = pa.array([None, *event[often].view("i8").tolist()], pa.int64())  # null stands for all
            yield pa.RecordBatch.from_arrays([names, pa.array([int(rows.sum()), *rows[often].tolist()], pa.int64())], names=["_event", "_rows"])

    counts = texts.select("text").mapInArrow(counted, "_event long, _rows long").groupBy("_event").agg(F.sum("_rows").alias("_rows"))
    counts = written(counts, "lm-hot")
    total = (counts.where("_event IS NULL").first() or (None, 0))[1]
    found = counts.where((F.col("_rows") * 2 * most >= total) & F.col("_event").isNotNull())  # at most twice ``most``
    return np.unique(np.array([r[0] for r in found.select("_event").collect()], "i8").view("u8"))


def events(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """The hot events of texts: ``_key``, ``_event`` (a bigram's hash), ``_n`` (twice its count in the text, and one
    more if the text is good)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, TEXT_BYTES):
            event, doc, n = _cells(batch["text"])
            found = _among(event, hot)
            event, doc, n = event[found], doc[found], n[found]
            n = 2 * n + batch["_good"].to_numpy()[doc]
            columns = [pa.array(batch["_key"].to_numpy()[doc]), pa.array(event.view("i8")), pa.array(n.astype("i8"))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_event", "_n"])

    return rows.select("_key", "_good", "text").mapInArrow(counted, "_key long, _event long, _n long")


def _planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, those of one place together."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, "u1").reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_events(rows: DataFrame, hot: np.ndarray, ranges: int) -> DataFrame:
    """All other events of texts: a row for each run of texts and range of events, with the keys of its texts, and for
    each event the difference to the one before, the place of its text among the keys, and ``_n`` as in :func:`events`."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, PACK_BYTES):
            keys, good = batch["_key"].to_numpy(), batch["_good"].to_numpy()
            event, doc, n = _cells(batch["text"])
            found = ~_among(event, hot)
            event, doc, n = event[found], doc[found], n[found]
            n = (2 * n + good[doc]).astype("<u4")
            part = (event >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype="u8"))
            out = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                own, place = np.unique(doc[a:b], return_inverse=True)
                steps = np.diff(event[a:b], prepend=np.uint64(0))
                out.append((k, keys[own].tobytes(), _planes(steps), _planes(place.astype("<u4")), _planes(n[a:b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], names=PACKED)

    schema = "_range long, _keys binary, _steps binary, _places binary, _counts binary"
    return rows.select("_key", "_good", "text").mapInArrow(packed, schema)


def scored_where_they_meet(packs: DataFrame, prior: float, scale: float) -> DataFrame:
    """``_key``, ``_sum`` (of the differences over its tokens in a range of events) and ``_n`` (these tokens)."""

    def scored(group: pa.Table) -> pa.Table:
        keys, event, place, n, before = [], [], [], [], 0
        for row in zip(*(group[c] for c in PACKED[1:])):
            own, steps, places, counts = (x.as_buffer() for x in row)
            keys.append(np.frombuffer(own, "i8"))
            event.append(np.cumsum(_values(steps, "<u8"), dtype="u8"))
            place.append(_values(places, "<u4") + np.uint32(before))
            n.append(_values(counts, "<u4"))
            before += len(keys[-1])
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        event, place, n = np.concatenate(event), np.concatenate(place), np.concatenate(n)
        order = np.argsort(event)
        event, text, n = event[order], which.astype("i4")[place[order]], n[order]
        starts = np.flatnonzero(np.concatenate([[True], event[1:] != event[:-1]]))
        same = np.diff(np.append(starts, len(event)))
        del event, place, order
        n, good = (n >> 1).astype("i8"), n & 1
        others = lambda counts: np.repeat(np.add.reduceat(counts, starts), same) - counts
        difference = np.log2(others(n) * scale + prior)
        difference -= np.log2(others(n * good) + prior)
        difference *= n
        sums, tokens = np.bincount(text, difference, len(own)), np.bincount(text, n, len(own))
        return pa.table({"_key": own, "_sum": sums, "_n": tokens.astype("i8")})

    return packs.groupBy("_range").applyInArrow(scored, "_key long, _sum double, _n long")


def models(cells: DataFrame) -> DataFrame:
    """``_event`` with its counts in the target (``t``) and in all documents (``a``)."""
    n, good = F.shiftright("_n", 1), F.col("_n").bitwiseAND(1)
    return cells.groupBy("_event").agg(F.sum(n * good).alias("t"), F.sum(n).alias("a"))


def _loss(count: Column, prior: float) -> Column:
    """Bits of an event, up to a constant that both models share."""
    return -F.log2(count + prior)


def word_cross_entropy(docs: DataFrame, labels: DataFrame, prior: float = PRIOR, most: int = COMMON) -> DataFrame:
    """doc_id, n_tokens and score (target loss minus background loss per token, in bits) of each document."""
    texts = documents(docs).withColumn("_key", F.xxhash64("doc_id", "text"))
    rows = labelled(texts, labels)
    sizes = labelled(texts.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("_size")), labels)  # no text is moved
    target, whole = sizes.agg(F.coalesce(F.sum(F.col("_size") * F.col("_good")), F.lit(0)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    scale = target / whole if target else 1.0
    hot = hot_events(texts, most)
    cells, counts = events(rows, hot), F.broadcast(models(events(rows, hot)))
    n, good = F.shiftright("_n", 1), F.col("_n").bitwiseAND(1)
    difference = _loss(F.col("t") - n * good, prior) - _loss((F.col("a") - n) * scale, prior)
    met = cells.join(counts, "_event").select("_key", (n * difference).alias("_sum"), n.alias("_n"))
    ranges = max(1, -(-whole // RANGE_BYTES))
    met = met.unionByName(scored_where_they_meet(packed_events(rows, hot, ranges), prior, scale))
    # rows that share a key are equal, so the mean is that of each
    means = met.groupBy("_key").agg((F.sum("_sum") / F.sum("_n")).alias("score"), F.sum("_n").alias("_tokens"))
    copies = texts.groupBy("_key", "doc_id").agg(F.count(F.lit(1)).alias("_copies"))
    scored = copies.join(means, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return scored.select("doc_id", F.floor(F.col("_tokens") / F.col("_copies")).alias("n_tokens"), "score")


@query("op5_cross_entropy")
def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_cross_entropy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
