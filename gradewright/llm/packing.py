"""Operator 6: documents packed into sequences by the sum-of-squares rule.

Only documents longer than a sequence are cut, into full pieces and one rest. Pieces are dealt evenly to tasks; each
task takes its pieces from long to short and puts each into the open sequence with room where the sum over gaps of
(open sequences with that gap) squared becomes smallest; a new one is opened only if none has room. Ties go to the
smallest gap that is left. A task of 100,000 pieces leaves a few open sequences; these are all that dealing the work costs.

Edge cases: a null or empty text is the separator alone, one piece of length 1; repeated rows are packed each; an
empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .registry import documents, query, table, written
from .tokens import default_path, encoder, slices

CAPACITY = 2_048
SEPARATOR = 0
PIECES_PER_TASK = 100_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece; the separator belongs to its document's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, offsets = encode.encode(batch.column(1), separator)
            ids, rows = ids.astype("<u4"), []
            for doc_id, begin, end in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                for k, start in enumerate(range(begin, end, capacity)):
                    part = ids[start : min(start + capacity, end)]
                    rows.append((doc_id, k, start - begin, len(part), zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents(docs).mapInArrow(cut, PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one is closed, an unused one has no gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, length in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[length:capacity]) + length
        rest = gaps - length
        # (c - 1)^2 - c^2 at the old gap; (c + 1)^2 - c^2 at the new one unless the sequence is full then
        change = 1 - 2 * count[gaps] + np.where(rest > 0, 2 * count[rest] + 1, 0)
        if len(gaps):
            gap = int(gaps[np.argmin(change)])
            number = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, number = capacity, used
            used += 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > length:
            open_by_gap[gap - length].append(number)
            count[gap - length] += 1
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to stored pieces; the table is counted and dealt evenly, without a key."""
    tasks = max(1, -(-cut.count() // per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.sort_by(order)
        number, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        number += TaskContext.get().partitionId() << 40
        rows = rows.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    # Spark sorts the rows before it deals them in turn, so a task that runs again gets the same ones
    return cut.repartition(tasks).mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(table(spark, sf_dir, "documents"), default_path()), "pieces"))
