"""Patches applied one after the other to the files that they share."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_AT_ONCE = 256


class _Files:
    """The files of one lineage as (lines, whether a line end closes the last), and one patch after the other."""

    def __init__(self):
        self.held: dict[str, tuple[list[str], bool]] = {}

    def put(self, path: str, content: str | None) -> None:
        lines = (content or "").split("\n")
        ends = lines[-1] == ""
        self.held[path] = (lines[:-1] if ends else lines, ends)

    def text(self, path: str) -> str:
        lines, ends = self.held[path]
        return "\n".join(lines) + ("\n" if lines and ends else "")

    def patch(self, row: dict) -> bool:
        source, target, status = row["path"], row["filename"], row["status"]
        if target is None or status is None or (source in self.held) == (status == "added") or (source != target and target in self.held):
            return False
        lines, ends = self.held.get(source, ([], True))
        out, cursor = [], 0
        for hunk in row["_hunks"]:
            old, size = hunk["old"], len(hunk["old"])
            first = max((hunk["old_start"] or 0) - min(size, 1), 0)
            if not hunk["sound"] or not cursor <= first <= len(lines) or lines[first : first + size] != old:
                return False
            out += lines[cursor:first] + hunk["new"]
            cursor = first + size
        ends = not row["_marked"] if cursor == len(lines) else ends
        out += lines[cursor:]
        if status == "removed" and out:
            return False
        self.held.pop(source, None)
        if status != "removed":
            self.held[target] = (out, ends or not out)
        return True


def patched_in_order(chains: DataFrame, names: Sequence[str]) -> DataFrame:
    """Lineages row by row: first their files, then their patches by ``pos``; memory holds one lineage's files."""
    types = {f.name: f.dataType.simpleString() for f in chains.schema.fields} | {"ok": "boolean"}
    order = ["instance_id", "_root", F.desc("_file"), "pos", "filename", "patch"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, files, schema = None, _Files(), None
        rows: list[dict] = []

        def leave() -> None:
            rows.extend({"instance_id": key[0], "path": p, "content": files.text(p)} for p in files.held)

        def batch_of_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)

        for batch in batches:
            fields = {f.name: f.type for f in batch.schema}
            schema = pa.schema([(n, pa.bool_() if n == "ok" else fields[n]) for n in names])
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                for row in batch.slice(start, ROWS_AT_ONCE).to_pylist():
                    if key != (row["instance_id"], row["_root"]):
                        if key is not None:
                            leave()
                        key, files = (row["instance_id"], row["_root"]), _Files()
                    if row["_file"]:
                        files.put(row["path"], row["content"])
                    else:
                        rows.append({n: row[n] for n in ("instance_id", "pos", "filename", "status")} | {"ok": files.patch(row)})
                if rows:
                    yield batch_of_rows()
                    rows.clear()
        if key is not None:
            leave()
            yield batch_of_rows()

    sorted_rows = chains.repartition("instance_id", "_root").sortWithinPartitions(*order)
    wanted = ["instance_id", "_root", "_file", "path", "pos", "filename", "status", "content", "_hunks", "_marked"]
    return sorted_rows.select(*wanted).mapInArrow(fold, ", ".join(f"{n} {types[n]}" for n in names))
