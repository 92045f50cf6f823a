"""Operator 11: importance resampling towards a target distribution.

Features are the runs of one and two words of a text, hashed into ``BUCKETS`` buckets. Each document keeps an array of
its buckets with their counts, bounded by the number of buckets however long the text is. Bucket totals of the corpus
and of the target are sums of these arrays, in each task first; the gain of a bucket compares its share in both. A
document's weight is the mean gain of its features, looked up by array; its score adds a Gumbel noise that depends on
seed and doc_id alone, so that the highest scores are a draw without replacement in proportion to the weights.

The draw is a threshold, not a sort of the corpus: scores are stored, and counting jobs halve the interval that holds
the cutoff (``HALVINGS`` steps of the bisection are answered by one job, which counts above that many midpoints at
once). Rows that tie at the cutoff are bisected by doc_id, and rows that share a doc_id too by their row number. Drawn rows
alone are then dealt by ranges of score for their ranks.

Edge cases: a null text has no words; a document without features has weight 0 and may be drawn only if it reaches
the words asked; a null doc_id hashes as the empty text and ties last; repeated rows are scored and drawn each; an
empty target or corpus leaves the smoothing; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import ranked
from .registry import query, table, written
from .shipping import ship
from .tokens import slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
HALVINGS = 4
PIECE_BYTES = 1 << 20
TEXT_BYTES = 4 << 20
ROWS_AT_ONCE = 1_000
LEAST_LONG = -(1 << 63)
SCORED = "doc_id long, n_features long, weight long, score long, _enough boolean, _row long"

#: Bytes of words stay (0-9, a-z, all of other scripts), A-Z become small, all else is a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: CRC-32 of one byte more, by the low byte of the state.
CRC_STEP = np.arange(256, dtype="u4")
for _ in range(8):
    CRC_STEP = (CRC_STEP >> 1) ^ np.where(CRC_STEP & 1, np.uint32(0xEDB88320), np.uint32(0))


def _behind_a_blank(checksums: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with a blank behind them, from those of the texts."""
    state = ~checksums
    return ~(CRC_STEP[(state & 0xFF) ^ 0x20] ^ (state >> 8))


def feature_checksums(text: bytes, piece: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Words and CRC-32 of all their runs of one and two, for a text in UTF-8 piece by piece (cut between words)."""
    line, start, last = text.translate(WORD_BYTES), 0, None
    while start < len(line):
        stop = line.find(b" ", start + piece) if len(line) - start > piece else -1
        words = line[start : stop if stop >= 0 else len(line)].split()
        start = stop if stop >= 0 else len(line)
        if not words:
            continue
        one = np.fromiter(map(zlib.crc32, words), "u4", len(words))
        before = _behind_a_blank(one if last is None else np.concatenate([last, one]))[:-1].tolist()
        two = np.fromiter(map(zlib.crc32, words[1:] if last is None else words, before), "u4", len(before))
        last = one[-1:]
        yield len(words), np.concatenate([one, two])


def bucket_arrays(docs: DataFrame, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """doc_id, ``_words``, ``_buckets`` and ``_counts`` (features by bucket, each bucket once) of each row."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most=TEXT_BYTES)):
            words, ids, counts = [], [], []
            for text in batch.column(1):
                n, total, found = 0, None, (np.zeros(0, "i8"), np.zeros(0, "i8"))
                for n_words, checksums in feature_checksums(text.as_py()):
                    n += n_words
                    if len(checksums) * 4 < buckets and total is None and not len(found[0]):
                        found = np.unique(checksums % buckets, return_counts=True)
                        continue
                    if total is None:
                        total = np.bincount(found[0].astype("i8"), found[1], buckets).astype("i8")
                    total += np.bincount(checksums % buckets, minlength=buckets)
                if total is not None:
                    found = (np.flatnonzero(total), total[total > 0])
                words.append(n)
                ids.append(found[0])
                counts.append(found[1])
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*x, np.zeros(0, "i8")]).astype("i4"))) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), *lists], names=["doc_id", "_words", "_buckets", "_counts"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, _words long, _buckets array<int>, _counts array<int>")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows that hold ``ROWS_AT_ONCE`` arrays at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts and the rows' offsets of a batch that has both arrays last."""
    ids, counts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(), counts.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype("i8")


def totals(arrays: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``_bucket`` and ``_n``, the features in it over all rows; each task adds its rows up first."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in _small(batches):
            ids, counts, _ = _flat(batch)
            np.add.at(total, ids, counts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"_bucket": seen.astype("i4"), "_n": total[seen]})

    sums = arrays.select("_buckets", "_counts").mapInArrow(added, "_bucket int, _n long")
    return sums.groupBy("_bucket").agg(F.sum("_n").alias("_n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the totals of both sides: ``buckets`` numbers, which is also all the driver reads."""
    sums = []
    for side in (corpus, target):
        found = side.toArrow()  # at most one row per bucket
        dense = [0] * buckets
        for bucket, n in zip(found["_bucket"].to_pylist(), found["_n"].to_pylist()):
            dense[bucket] = n
        sums.append(dense)
    s, t = sums
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], "i8")


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(arrays: DataFrame, gain: np.ndarray, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, ``_enough`` (words to be drawn) and ``_row``, a number of the stored row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in _small(batches):
            ids, counts, cuts = _flat(batch)
            features, worth = (np.concatenate([[0], np.cumsum(x)])[cuts] for x in (counts, gain[ids] * counts))
            features, worth = np.diff(features), np.diff(worth)
            weight = np.floor_divide(worth, np.maximum(features, 1))
            noises = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], "i8")
            rows = number + np.arange(batch.num_rows, dtype="i8")
            number += batch.num_rows
            enough = pc.greater_equal(batch.column(1), least_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features), pa.array(weight), pa.array(weight + noises), enough, pa.array(rows)],
                names=["doc_id", "n_features", "weight", "score", "_enough", "_row"],
            )

    return arrays.select("doc_id", "_words", "_buckets", "_counts").mapInArrow(score, SCORED)


def cutoff(rows: DataFrame, keys: list[Column], k: int, halvings: int = HALVINGS) -> Column:
    """A condition that holds for exactly the ``k`` rows with the greatest ``keys`` (whole numbers, unique together).

    For each key in turn the greatest value that ``k`` rows reach is found by counting jobs; the rows above it are in,
    those at it go on to the next key.
    """
    if k <= 0:
        return F.lit(False)
    chosen, tied, wanted = F.lit(False), F.lit(True), k
    for key in keys:
        here = rows.where(tied).select(key.alias("_key"))
        low, high, n = here.agg(F.min("_key"), F.max("_key"), F.count(F.lit(1))).first()
        if n <= wanted:
            return chosen | tied
        above = 0  # rows with a key beyond ``high``
        at_low = n  # rows with a key of ``low`` or more: always ``wanted`` at least
        while low < high:
            parts = 1 << halvings
            marks = sorted({low + -(-(high - low) * j // parts) for j in range(1, parts + 1)} - {low})
            reach = here.agg(*[F.count(F.when(F.col("_key") >= m, 1)).alias(f"_m{i}") for i, m in enumerate(marks)]).first()
            for mark, count in zip(marks, reach):
                if count >= wanted:
                    low, at_low = mark, count
                else:
                    high, above = mark - 1, count
                    break
        if at_low == wanted:
            return chosen | (tied & (key >= low))
        chosen, tied, wanted = chosen | (tied & (key > low)), tied & (key == low), wanted - above
    return chosen


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    seed: int = SEED, halvings: int = HALVINGS, target_key: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null for rows that are not drawn) of every row of ``docs``."""
    arrays = written(bucket_arrays(docs, buckets), "resampling-arrays")
    wanted = bucket_arrays(target, buckets, target_key)
    gain = gains(totals(arrays, buckets), totals(wanted, buckets), buckets)
    rows = written(scored(arrays, gain, least_words, seed), "resampling-scores")
    able = rows.where("_enough")
    k = percent * able.count() // 100
    # the bit complement turns the order round without overflow; a null id ties behind all others
    keys = [F.col("score"), F.coalesce(F.bitwise_not("doc_id"), F.lit(LEAST_LONG)), F.bitwise_not("_row")]
    drawn = F.col("_enough") & cutoff(able, keys, k, halvings)
    names = ["doc_id", "n_features", "weight", "score"]
    places = ranked(rows.where(drawn), [key.desc() for key in keys], "resampling-drawn")
    rest = rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))
    return places.select(*names, (F.col("_rank") + 1).alias("rank")).unionByName(rest)


SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (
  SELECT row_number() OVER () AS id, doc_id, text, true AS own FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
words AS (
  SELECT id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT id, own, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM words),
counted AS (SELECT id, own, f, count(*) AS n FROM features GROUP BY ALL),
bytes AS (
  SELECT f, list_transform(range(strlen(f)), lambda k: ('0x' || hex(encode(f))[2 * k + 1 : 2 * k + 2])::BIGINT) AS b
  FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce([4294967295] || b, lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
cells AS (SELECT id, own, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM cells GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (t_s.s_all + 10000))::DOUBLE / ((s + 1) * (t_s.t_all + 10000))::DOUBLE))::BIGINT AS g
  FROM sums, whole t_s),
weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM cells JOIN gain USING (bucket) WHERE own GROUP BY id),
scores AS (
  SELECT d.id, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS enough,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(d.doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts d JOIN words USING (id) LEFT JOIN weighed USING (id) WHERE d.own),
placed AS (
  SELECT *, CASE WHEN enough THEN row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (enough) OVER () AS able
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM placed
"""


@query("op11_resampling", SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
