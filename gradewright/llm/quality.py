"""Operator 2: quality by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics (sizes as logarithms, shares as logarithms above a floor).
Each class has a Gaussian whose covariance is shrunk towards the pooled one and then towards a multiple of the
identity. The score is the logistic function of the difference of the log densities (Mahalanobis distances by the
cached Cholesky factors) plus that of the class shares.

Fitting needs the count, the sum and the products of the vectors of each class only: Spark sums them over all
labelled rows outside the held-out fold, and a few hundred numbers reach the driver.

Edge cases: a null text is empty, the vector of an empty text is defined (all sizes and shares zero); a null doc_id
is scored, never matches a label, and is not held out; a label that is null or neither 0 nor 1 is ignored; a row
with several labels counts once for each; with no labels every score is 0.5, with one class it is that class's
smoothed share; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query, table, written

FOLDS = 5
THRESHOLD = 0.3
POOLED, IDENTITY = 0.1, 0.02
FLOOR = 5e-3
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS = re.compile(b"[A-Z]|\xc3[\x80-\x96\x98-\x9e]")  # of Latin-1, in UTF-8
DIGITS = b"0123456789"
STOPS = b".,;:"
MARKS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:'\"-()" and not chr(c).isalnum())
SHOUTS = b"!?"


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text in UTF-8."""
    size = max(1, len(text))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))

    def share(part: float, whole: float) -> float:
        return math.log(FLOOR + part / whole)

    def of(kind: bytes) -> float:
        return share(len(text) - len(text.translate(None, kind)), size)

    return [
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        share(len(set(words)), n),
        share(len(set(lines)), len(lines)),
        math.log1p(len(lines)),
        share(len({w.strip(b".,;:!?*$&%#|").lower() for w in words}), n),
        of(LETTERS), share(len(CAPITALS.findall(text)), size), of(DIGITS), of(STOPS), of(MARKS), of(SHOUTS),
        share(sum(1 for w in words if w.isupper()), n),
        share(sum(1 for w in words if len(w) == 1), n),
    ]


SIZE = len(statistics(b""))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and ``_v``, the statistics of the whole text."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "_v"])

    return documents(docs).mapInArrow(measured, "doc_id long, _v array<double>")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1))


@dataclass(frozen=True)
class Gaussian:
    """A class: its mean, the inverse of its Cholesky factor, and its log density's constant with the class share."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * np.square((x - self.mean) @ self.whiten.T).sum(axis=1)


@dataclass(frozen=True)
class Model:
    classes: tuple[Gaussian, Gaussian] | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if self.classes is None:
            return np.full(len(x), self.share)
        bad, good = (c.log_density(x) for c in self.classes)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def moments(vectors_: DataFrame, labels: DataFrame, label: str) -> dict[int, np.ndarray]:
    """For each class the sums of 1, x and x x' over all labelled rows, flat."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, SIZE)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for k in (0, 1):
            if total[k, 0]:
                yield pa.RecordBatch.from_pydict({"y": [k] * total.shape[1], "at": np.arange(total.shape[1]), "sum": total[k]})

    sums = vectors_.join(known, "doc_id").select("_v", "_y").mapInArrow(summed, "y long, at long, sum double")
    found = {k: np.zeros(1 + SIZE + SIZE * SIZE) for k in (0, 1)}
    for row in sums.groupBy("y", "at").agg(F.sum("sum").alias("sum")).collect():  # a few hundred numbers
        found[row["y"]][row["at"]] = row["sum"]
    return found


def fit(vectors_: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """Both class Gaussians from all given vectors that have a label."""
    sums = moments(vectors_, labels, label)
    counts = [sums[k][0] for k in (0, 1)]
    share = (counts[1] + 1) / (sum(counts) + 2)
    if not all(counts):
        return Model(None, share)
    means = [sums[k][1 : 1 + SIZE] / counts[k] for k in (0, 1)]
    scatter = [sums[k][1 + SIZE :].reshape(SIZE, SIZE) - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / sum(counts)
    classes = []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / counts[k] + pooled * common
        own = (1 - identity) * own + identity * max(np.trace(own) / SIZE, FLOOR) * np.eye(SIZE)
        factor = np.linalg.cholesky(own)
        prior = math.log(share if k else 1 - share)
        classes.append(Gaussian(means[k], np.linalg.inv(factor), prior - np.log(np.diag(factor)).sum()))
    return Model((classes[0], classes[1]), share)


def scored(vectors_: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return vectors_.select("doc_id", "_v").mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from the labelled rows that are not held out."""
    measured = written(vectors(docs), "quality-vectors")
    model = fit(measured.where(fold(F.col("doc_id")) != 0), labels)
    return scored(measured, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches the threshold. Scored in place: nothing is shuffled."""
    model = fit(written(vectors(docs).where(fold(F.col("doc_id")) != 0), "quality-vectors"), labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            scores = model.score(np.array([statistics(t or b"") for t in texts]).reshape(-1, SIZE))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
