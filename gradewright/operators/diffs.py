"""Diff text to tables and back, checks on diffs, and applying hunks to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diffs import (
    assemble_diff, chunk_lines, extract_file_info, extract_hunks, read_hunk, split_files, split_hunks,
)
from ..functions.paths import is_test_patch
from ..functions.text import let
from ..schemas import FILE_CHANGES
from .layout import components, nest_in_chunks, stored
from .patch_chains import patched_in_order

LINES = "array<string>"


def parse_unified_diff(df: DataFrame, id: str = "instance_id", col: str = "diff") -> DataFrame:
    """One row per file of a diff; chunks without a git header are dropped."""
    return parse_chunks(df.select(id, F.posexplode(split_files(F.col(col))).alias("pos", "chunk")), id)


def parse_chunks(chunks: DataFrame, id: str = "path") -> DataFrame:
    """One row per chunk of a diff (``pos``, ``chunk``) that has a git header: a diff of any size, chunk by chunk."""
    lines = chunks.select(id, "pos", chunk_lines(F.col("chunk")).alias("_lines"))
    # a generator drops the headless chunks, so that no filter repeats the extraction
    named = F.filter(F.array(extract_file_info(F.col("_lines"))), lambda i: i["filename"].isNotNull())
    files = lines.select(id, "pos", "_lines", F.inline(named))
    return files.select(
        id,
        "pos",
        "filename",
        "status",
        "old_filename",
        extract_hunks(F.col("_lines")).alias("patch"),
        is_test_patch(F.col("filename")).alias("is_test"),
    )


def filter_patch_kind(
    patch_files: DataFrame, include_test: bool = True, include_source: bool = True
) -> DataFrame:
    is_test = F.col("is_test")
    return patch_files.where((is_test & F.lit(include_test)) | (~is_test & F.lit(include_source)))


def filter_applicable_changes(file_changes: DataFrame) -> DataFrame:
    """File changes with a name, a status and a non-empty patch."""
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("filename", "patch", "status")]
    return file_changes.where(given[0] & given[1] & given[2])


def validate_diff(df: DataFrame, col: str = "diff", id: str = "instance_id") -> DataFrame:
    """One row per hunk with ``ok``: the body has the line counts that its header states."""
    chunks = df.select(id, F.explode(split_files(F.col(col))).alias("_chunk"))
    files = chunks.select(
        id,
        extract_file_info(chunk_lines(F.col("_chunk")))["filename"].alias("path"),
        split_hunks(F.col("_chunk")).alias("_hunks"),
    )
    hunks = files.select(id, "path", F.posexplode("_hunks").alias("hunk", "_text"))
    return hunks.select(id, "path", "hunk", read_hunk(F.col("_text"))["sound"].alias("ok"))


def invalid_instances(checked: DataFrame, id: str = "instance_id") -> DataFrame:
    """Instances with an unsound hunk."""
    return checked.where("NOT ok").select(id).distinct()


def standardise_instances(df: DataFrame) -> DataFrame:
    """Diff text in ``patch``/``test_patch``; the per-file lists move to ``*_files``."""
    none = F.array().cast(FILE_CHANGES)
    lists = {
        "patch_files": F.coalesce("patch", none),
        "test_patch_files": F.coalesce("test_patch", none),
    }
    return df.withColumns(lists).withColumns({
        "patch": assemble_diff(F.col("patch_files")),
        "test_patch": assemble_diff(F.col("test_patch_files")),
    })


def change_size_stats(
    file_changes: DataFrame, keys: Sequence[str] = ("instance_id", "is_test")
) -> DataFrame:
    """Lines added, deleted and changed per group, and files where changes is not their sum."""
    odd = F.col("changes") != F.col("additions") + F.col("deletions")
    return file_changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.sum("changes").alias("changes"),
        F.count_if(odd).alias("inconsistent"),
    )


def diff_kind_counts(patch_files: DataFrame, id: str = "instance_id") -> DataFrame:
    """Files and test files of every diff."""
    return patch_files.groupBy(id).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_test").alias("test_files")
    )


def patch_application_summary(
    applied: DataFrame, patches: DataFrame | None = None, id: str = "instance_id", col: str = "diff", size: int = 10_000
) -> DataFrame:
    """Files, successfully applied files and the names of these in patch order, of every instance: (id, chunk,
    total_files_num, applied_files_num, applied_files).

    Names come in arrays of at most ``size`` by :func:`nest_in_chunks`; an instance whose positions stay below has one
    row (chunk 0), any other repeats its numbers in each. With ``patches`` (id, ``col``), every diff has its row, also
    one that names no file, and chunk 0 has its text as ``patch_content``.
    """
    names = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "filename"))))
    parts = applied.groupBy(id, F.floor(F.col("pos") / size).alias("chunk")).agg(
        F.count(F.lit(1)).alias("_files"), F.count_if("ok").alias("_applied"), names.alias("_names")
    )
    whole = Window.partitionBy(id)  # a row for ``size`` files
    summary = parts.select(
        id, "chunk", F.sum("_files").over(whole).alias("total_files_num"), F.sum("_applied").over(whole).alias("applied_files_num"),
        F.transform("_names", lambda n: n["filename"]).alias("applied_files"), F.min("chunk").over(whole).alias("_first"),
    )
    if patches is None:
        return summary.drop("_first")
    same = F.col("p._id").eqNullSafe(F.col(f"s.{id}"))
    joined = patches.select(F.col(id).alias("_id"), F.col(col).alias("_text")).alias("p").join(summary.alias("s"), same, "left")
    chunk, none = F.coalesce("chunk", F.lit(0)), F.lit(0).cast("bigint")
    return joined.select(
        F.col("_id").alias(id), chunk.alias("chunk"), F.coalesce("total_files_num", none).alias("total_files_num"),
        F.coalesce("applied_files_num", none).alias("applied_files_num"), F.coalesce("applied_files", F.array().cast(LINES)).alias("applied_files"),
        F.when(F.coalesce("_first", F.lit(0)) == chunk, F.col("_text")).alias("patch_content"),
    )


def applied_files(applied: DataFrame, id: str = "instance_id", size: int = 10_000) -> DataFrame:
    """Names of the applied files in patch order, in arrays of at most ``size``."""
    done = applied.where("ok")
    return nest_in_chunks(done, [id], "pos", F.col("filename"), "applied_files", size)


def _patched(lines: Column, hunks: Column) -> Column:
    """``struct<out, cursor, ok>`` of applying all hunks to the lines of a file, each line copied once.

    A hunk's place follows from its header alone, so the text between two hunks is known without a running state.
    """
    # a hunk without old lines stands after its line, any other on it
    first = lambda h: F.greatest(F.coalesce(h["old_start"], F.lit(0)) - F.least(F.size(h["old"]), F.lit(1)), F.lit(0))
    placed = F.transform(hunks, lambda h: F.struct(
        first(h).alias("first"), (first(h) + F.size(h["old"])).alias("end"), h["old"].alias("old"), h["new"].alias("new"), h["sound"].alias("sound")
    ))

    def apply(placed: Column) -> Column:
        def before(i: Column) -> Column:
            return F.when(i == 0, F.lit(0)).otherwise(F.get(placed, i - 1)["end"])

        def piece(h: Column, i: Column) -> Column:
            gap = F.greatest(h["first"] - before(i), F.lit(0))
            return F.concat(F.slice(lines, before(i) + 1, gap), h["new"])

        def fits(h: Column, i: Column) -> Column:
            here = F.slice(lines, h["first"] + 1, F.size(h["old"]))
            whole = h["sound"] & (h["first"] >= before(i)) & (h["first"] <= F.size(lines)) & (here == h["old"])
            return F.coalesce(whole, F.lit(False))

        return F.struct(
            F.flatten(F.transform(placed, piece)).cast(LINES).alias("out"),
            F.when(F.size(placed) > 0, F.get(placed, F.size(placed) - 1)["end"]).otherwise(F.lit(0)).alias("cursor"),
            F.forall(F.transform(placed, fits), lambda ok: ok).alias("ok"),
        )

    return let(placed, apply)


def lineages(patch_files: DataFrame) -> DataFrame:
    """(instance_id, path, root): paths that renames of an instance connect, each with the smallest path among them."""
    moved = patch_files.where("status = 'renamed' AND old_filename IS NOT NULL")
    edges = moved.select("instance_id", F.col("old_filename").alias("a"), F.col("filename").alias("b"))
    return components(edges, ["instance_id"]).withColumnRenamed("node", "path")


def apply_hunks(files: DataFrame, patch_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply parsed patches at their exact places, in the order of ``pos``: files afterwards, and success per patch.

    ``files`` has (instance_id, path, content), ``patch_files`` one row per file of a diff; ``pos`` orders all patches
    of an instance, so those of a second diff go on counting where the first ended. Paths that renames connect are
    one lineage, whose files and patches meet in one task; a patch sees what those before it left. A patch whose
    context differs anywhere, that adds or renames to a file that is there, or changes one that isn't, fails and
    leaves everything as it was; later ones go on.

    A lineage of at most one file and one patch, as most are, is patched by column expressions. Longer ones are
    streamed through their task in order, so that of a chain only the files in their present state are held. The patches
    are stored first: lineages, sizes and the work itself read them, and a diff is parsed once.
    """
    patch_files = stored(patch_files.select("instance_id", "pos", "filename", "status", "old_filename", "patch"), "patches")
    source = F.when(F.col("status") == "renamed", F.coalesce("old_filename", "filename")).otherwise(F.col("filename"))
    hunks = F.transform(split_hunks(F.coalesce("patch", F.lit(""))), read_hunk)
    # where the hunks reach the end of the file, a marker behind a new line leaves its end open
    marked = F.coalesce("patch", F.lit("")).rlike(r"(?:^|\n)[ +][^\n]*\n\\")
    position = patch_files.schema["pos"].dataType
    rows = files.select(
        "instance_id", "path", F.lit(None).cast(position).alias("pos"), F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("status"), "content", F.lit(None).cast("string").alias("patch"), F.lit(True).alias("_file"),
    ).unionByName(patch_files.select(
        "instance_id", source.alias("path"), "pos", "filename", "status", F.lit(None).cast("string").alias("content"), "patch",
        F.lit(False).alias("_file"),
    ))
    rows = rows.join(lineages(patch_files), ["instance_id", "path"], "left").withColumn("_root", F.coalesce("root", "path")).drop("root")
    key = ["instance_id", "_root"]
    sized = rows.groupBy(*key).agg(
        F.count_if("_file").alias("_files"), F.count_if(~F.col("_file")).alias("_patches"),
        F.first(F.when(F.col("_file"), F.struct("path", "content")), ignorenulls=True).alias("_old"),
        F.first(F.when(~F.col("_file"), F.struct("path", "pos", "filename", "status", "patch")), ignorenulls=True).alias("_new"),
    )
    names = ["instance_id", "path", "pos", "filename", "status", "content", "ok"]
    alone = _patched_alone(sized.where("_patches <= 1 AND _files <= 1"), marked).select(*names)
    many = sized.where("_patches > 1 OR _files > 1").select(*key, "_files", "_patches")
    same = F.col("r.instance_id").eqNullSafe(F.col("s.instance_id")) & F.col("r._root").eqNullSafe(F.col("s._root"))
    rows = rows.alias("r").join(many.alias("s"), same).select("r.*", "s._files", "s._patches")
    untouched = rows.where("_patches = 0").withColumn("ok", F.lit(None).cast("boolean")).select(*names)
    chains = rows.where("_patches > 0").withColumns({"_hunks": hunks, "_marked": marked})
    done = alone.unionByName(untouched).unionByName(patched_in_order(chains, names))
    status = _taken(done, F.col("ok").isNotNull(), "instance_id", "pos", "filename", "status", "ok")
    after = _taken(done, F.col("content").isNotNull() | F.col("ok").isNull(), "instance_id", "path", "content")
    return after, status


def _taken(done: DataFrame, wanted: Column, *names: str) -> DataFrame:
    """Columns of the wanted rows, by a generator: a filter would move down and patch every file once more."""
    times = F.when(wanted, F.lit(1)).otherwise(F.lit(0))
    return done.select(F.explode(F.array_repeat(F.struct(*names), times)).alias("_row")).select("_row.*")


def _patched_alone(alone: DataFrame, marked: Column) -> DataFrame:
    """Lineages of one patch and one file at most: ``content`` and ``path`` are those afterwards, null if there is none.

    A file without a patch stays as it is, with a null ``ok``.
    """
    given, old = F.col("_new").isNotNull(), F.col("_old.content")
    rows = alone.select(
        "instance_id", F.col("_new.pos").alias("pos"), F.col("_new.filename").alias("filename"), F.col("_new.status").alias("status"),
        F.col("_new.patch").alias("patch"), F.col("_old.path").alias("_path"), given.alias("_given"),
        F.when(given & F.col("_old").isNotNull(), F.coalesce(old, F.lit(""))).otherwise(old).alias("_content"),
        (F.col("_old.path") == F.col("_new.path")).alias("_here"),
    )
    exists = F.coalesce("_here", F.lit(False))
    text = F.coalesce(F.when(exists, F.col("_content")), F.lit(""))
    ends = (text == "") | text.endswith("\n")
    lines = F.split(text, "\n")
    lines = F.when(ends, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    hunks = F.transform(split_hunks(F.coalesce("patch", F.lit(""))), read_hunk)
    ready = rows.withColumns({"_lines": lines, "_ends": ends}).withColumn("_r", _patched(F.col("_lines"), hunks))
    ready = ready.withColumn("_out", F.concat("_r.out", F.slice("_lines", F.col("_r.cursor") + 1, F.size("_lines"))))
    out = F.col("_out")
    # a rename to a file that is there has two files in its lineage, or one that isn't its source
    free = F.col("_path").isNull()
    fits = F.when(F.col("status") == "added", free).otherwise(exists)
    emptied = (F.col("status") != "removed") | (F.size(out) == 0)
    open_end = F.when(F.col("_r.cursor") == F.size("_lines"), marked).otherwise(~F.col("_ends"))
    new_text = F.when(F.size(out) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(out, "\n"), F.when(open_end, F.lit("")).otherwise(F.lit("\n")))
    )
    result = ready.withColumn("ok", F.when(F.col("_given"), F.coalesce(F.col("_r.ok") & fits & emptied, F.lit(False)))).withColumn("_text", new_text)
    return result.withColumns({
        "path": F.when(F.col("ok"), F.col("filename")).otherwise(F.col("_path")),
        "content": F.when(F.col("ok"), F.when(F.col("status") != "removed", F.col("_text"))).otherwise(F.col("_content")),
    })
