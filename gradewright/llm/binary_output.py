"""Operator 9: token ids as flat unsigned files with 64-bit document offsets.

A part is four files: ``ids`` (flat unsigned 16- or 32-bit integers, by the size of the vocabulary), ``offsets``
(``n_docs + 1`` unsigned 64-bit starts inside the part), ``docs`` (64-bit doc ids) and ``known`` (one byte for each
document, 0 where the doc id is null). Parts are numbered in ascending doc_id order; the base of a part is the
prefix sum of the tokens of the parts before it, kept in the manifest.

Edge cases: a null text is empty and has the end id alone; null doc ids come first; rows that share a doc_id stand
side by side, ordered by a hash of their text; an empty table writes no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .registry import documents, query, table
from .tokens import default_path, encoder, slices

END_ID = 1
DOCS_PER_READ = 4_096


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_parts(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> list[tuple]:
    """Write all documents below ``path``; the manifest: (part, n_docs, n_tokens, base, width) in order of parts.

    Documents are dealt by ranges of (doc_id, hash of the text, row), so that neither a hot doc_id nor copies meet
    in one task. A part is written under a name of the task's attempt and renamed when whole: a task that runs again
    replaces it by the same bytes.
    """
    keys = ["doc_id", "_hash", "_row"]
    rows = documents(docs).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoder(tokenizer)
        system, folder = place(path)
        part, attempt = task.partitionId(), task.taskAttemptId()
        name, names = f"{folder}/part-{part:06d}", ("ids", "offsets", "docs", "known")
        files, total, n_docs = None, 0, 0
        for batch in (part for whole in batches for part in slices(whole)):
            if files is None:
                system.create_dir(folder, recursive=True)
                files = [system.open_output_stream(f"{name}.{x}.{attempt}") for x in names]
                files[1].write(np.zeros(1, "<u8").tobytes())
            ids, offsets = encode.encode(batch.column(1), end_id)
            doc_ids = batch.column(0)
            for file, data in zip(files, (
                ids, (total + offsets[1:]).astype("<u8"),
                doc_ids.fill_null(0).to_numpy().astype("<i8"), doc_ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"),
            )):
                file.write(data.tobytes())
            total += len(ids)
            n_docs += batch.num_rows
        if files is not None:
            for file, x in zip(files, names):
                file.close()
                system.move(f"{name}.{x}.{attempt}", f"{name}.{x}")
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [total], "width": [encode.dtype.itemsize]})

    found = (
        ranged.sortWithinPartitions(*keys).select("doc_id", "text")
        .mapInArrow(write, "part long, n_docs long, n_tokens long, width long").collect()  # one row a file
    )
    found = sorted(tuple(r) for r in found)
    bases = [0, *accumulate(r[2] for r in found)]
    return [(part, n, tokens, base, width) for (part, n, tokens, width), base in zip(found, bases)]


def mapped(path: str, dtype: str, start: int, count: int) -> np.ndarray:
    """``count`` values from ``start``: memory-mapped where the folder is mounted, else read by range."""
    system, name = place(path)
    size = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r", offset=start * size, shape=(count,))
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read_at(count * size, start * size), dtype)


def read_documents(spark: SparkSession, path: str, manifest: list[tuple]) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    reads = [(part, base, width, at, min(DOCS_PER_READ, n - at)) for part, n, _, base, width in manifest for at in range(0, n, DOCS_PER_READ)]
    schema = "part long, base long, width long, at long, n long"
    spans = spark.createDataFrame(reads or [(0, 0, 2, 0, 0)], schema).where("n > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, at, n = f"{path}/part-{row['part']:06d}", row["at"], row["n"]
                offsets = mapped(f"{name}.offsets", "<u8", at, n + 1).astype("i8")
                doc_ids, known = mapped(f"{name}.docs", "<i8", at, n), mapped(f"{name}.known", "u1", at, n)
                ids = mapped(f"{name}.ids", f"<u{row['width']}", int(offsets[0]), int(offsets[-1] - offsets[0]))
                cuts = offsets - offsets[0]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(doc_ids), pa.int64(), mask=np.array(known) == 0),
                        pa.array(row["base"] + offsets[:-1], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spans.repartition(max(1, min(len(reads), 10_000)), "part", "at").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    return read_documents(spark, path, write_parts(table(spark, sf_dir, "documents"), path, default_path()))
