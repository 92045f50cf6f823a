"""Column functions that write and read git diff text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def build_file_diff(
    filename: Column, status: Column, patch: Column, old_filename: Column
) -> Column:
    """Git header for the status of a file followed by its hunks (a null patch is empty)."""
    hunks = F.coalesce(patch, F.lit(""))
    old = F.coalesce(F.nullif(old_filename, F.lit("")), filename)
    # The header lines are a format.
    head = _text("diff --git a/", filename, " b/", filename, "\n")
    added = _text(
        head, "new file mode 100644\nindex 0000000..1111111\n--- /dev/null\n+++ b/", filename, "\n"
    )
    removed = _text(
        head, "deleted file mode 100644\nindex 1111111..0000000\n--- a/", filename,
        "\n+++ /dev/null\n",
    )
    renamed = _text(
        "diff --git a/", old, " b/", filename, "\nsimilarity index 100%\nrename from ", old,
        "\nrename to ", filename, "\n",
    )
    modified = _text(
        head, "index 1111111..2222222 100644\n--- a/", filename, "\n+++ b/", filename, "\n"
    )
    header = (
        F.when(status == "added", added)
        .when(status == "removed", removed)
        .when(status == "renamed", renamed)
        .otherwise(modified)
    )
    return F.concat(header, hunks)


def _drop_final_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def assemble_diff(patches: Column) -> Column:
    """One diff of an array of file changes, in array order; null or empty gives ''."""

    def one(p: Column) -> Column:
        text = build_file_diff(p["filename"], p["status"], p["patch"], p["old_filename"])
        return _drop_final_newlines(text)

    return F.coalesce(F.array_join(F.transform(patches, one), "\n"), F.lit(""))


def _begins(line: Column, *marks: str) -> Column:
    """Whether a line has one of ``marks`` in front, or nothing but a line end (plain comparisons, a pattern costs more)."""
    return reduce(or_, [line.startswith(mark) for mark in marks], line.isin("", "\r", "\n", "\r\n", "\x85", "\u2028", "\u2029"))


def split_files(diff: Column) -> Column:
    """The per-file chunks of a diff."""
    return F.split(diff, r"\n(?=diff --git)")


def chunk_lines(chunk: Column) -> Column:
    return F.split(strip(chunk), "\n")


def extract_file_info(lines: Column) -> Column:
    """``struct<filename, status, old_filename>`` of one file chunk; filename null if headless."""
    header = r"^diff --git a/(.*?) b/(.*)$"

    def build(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        hunk = F.array_position(F.transform(lines, lambda line: line.startswith("@@")), F.lit(True))
        head = F.when(hunk > 0, F.slice(lines, F.lit(1), F.greatest(hunk.cast("int") - 1, F.lit(0)))).otherwise(lines)
        marks = F.filter(head, lambda line: line.startswith("new file") | line.startswith("deleted file") | line.startswith("rename from"))

        def name(parts: Column) -> Column:
            mark, old, new = parts["mark"], parts["old"], parts["new"]
            status = (
                F.when(mark.startswith("new file mode"), "added")
                .when(mark.startswith("deleted file mode"), "removed")
                .when(mark.startswith("rename from"), "renamed")
            )
            is_removed, is_renamed = status == "removed", status == "renamed"
            return F.struct(
                F.nullif(F.when(is_removed, old).otherwise(new), F.lit("")).alias("filename"),
                F.coalesce(status, F.lit("modified")).alias("status"),
                F.when(is_renamed, old).alias("old_filename"),
            )

        parts = F.struct(
            F.get(marks, F.lit(0)).alias("mark"),
            F.regexp_extract(first, header, 1).alias("old"),
            F.regexp_extract(first, header, 2).alias("new"),
        )
        return let(parts, name)

    return let(lines, build)


def extract_hunks(lines: Column) -> Column:
    """Hunk text of a chunk: from the first '@@' on, header and body lines; '\\' lines always."""

    def build(lines: Column) -> Column:
        marked = F.transform(lines, lambda line: line.startswith("@@"))

        def cut(start: Column) -> Column:
            def keep(line: Column, index: Column) -> Column:
                inside = (start > 0) & (index + 1 >= start)
                return (inside & _begins(line, "@@", "+", " ", "-")) | line.startswith("\\")

            return F.array_join(F.filter(lines, keep), "\n")

        return let(F.array_position(marked, F.lit(True)), cut)

    return let(lines, build)


HUNK_HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def split_hunks(text: Column) -> Column:
    """The hunks of one file, each with its header line; text before the first is left out."""
    return F.filter(F.split(text, r"\n(?=@@)"), lambda part: part.startswith("@@"))


def read_hunk(hunk: Column) -> Column:
    """``struct<old_start, old, new, sound>`` of a hunk.

    ``old`` and ``new`` are the lines before and after the change, without markers. ``sound`` says
    whether there are as many of each as the header states; a length left out there means 1.
    """

    def sides(lines: Column) -> Column:
        body = F.slice(lines, F.lit(2), F.size(lines))
        bare = lambda line: F.substring(line, 2, 2**31 - 1)
        return F.struct(
            F.get(lines, F.lit(0)).alias("header"),
            F.transform(F.filter(body, lambda x: _begins(x, " ", "-")), bare).alias("old"),
            F.transform(F.filter(body, lambda x: _begins(x, " ", "+")), bare).alias("new"),
        )

    def check(parts: Column) -> Column:
        header = parts["header"]

        def length(group: int) -> Column:
            stated = F.regexp_extract(header, HUNK_HEADER, group)
            return F.when(stated == "", 1).otherwise(stated.try_cast("int"))

        sound = (
            header.rlike(HUNK_HEADER)
            & (F.size(parts["old"]) == length(2))
            & (F.size(parts["new"]) == length(4))
        )
        return F.struct(
            F.regexp_extract(header, HUNK_HEADER, 1).try_cast("int").alias("old_start"),
            parts["old"].alias("old"),
            parts["new"].alias("new"),
            F.coalesce(sound, F.lit(False)).alias("sound"),
        )

    return let(let(F.split(hunk, "\n"), sides), check)
