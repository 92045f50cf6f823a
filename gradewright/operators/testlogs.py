"""From raw test logs to one status per test."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, SPACES, base_test_name, strip_ansi
from .layout import heavy_keys, numbered, skew_join

STATUSES = ("PASSED", "FAILED", "SKIPPED", "ERROR")
ALL_STATUSES = (*STATUSES, "UNKNOWN")
SUMMARY = "short test summary info"
ANY_STATUS = "|".join(STATUSES)
NO_SPACE = SPACE.replace("[", "[^", 1)
CANDIDATE = rf"(?U)^{SPACE}*(?:{ANY_STATUS}){SPACE}+{NO_SPACE}"
# '.' and '$' stop at a line feed only; the name ends at the first " - " that has text behind it.
TEST_LINE = (
    rf"(?Ud)^{SPACE}*(?:{ANY_STATUS}){SPACE}+(.+?){SPACE}*"
    rf"(?:{SPACE}-{SPACE}.*{NO_SPACE})?{SPACE}*$"
)


def _status(line: Column) -> Column:
    """The status word of a candidate line, the first behind its white space."""
    text = F.ltrim(line, F.lit(SPACES))
    return reduce(lambda status, word: status.when(text.startswith(word), word), STATUSES[1:], F.when(text.startswith(STATUSES[0]), STATUSES[0]))


def parse_test_log(logs: DataFrame, log: str = "log") -> DataFrame:
    """One row per status line of a log: all other columns, ``pos``, ``test`` and ``status``.

    Lines count from the summary heading on, or from the start where a log has none. A plain
    search for the status words comes before any pattern, since most lines of a log have none.
    """
    keep = [c for c in logs.columns if c != log]
    has_codes = F.col(log).contains("\x1b")
    clean = logs.select(
        *keep, F.when(has_codes, strip_ansi(F.col(log))).otherwise(F.col(log)).alias("_clean")
    )
    start = F.greatest(F.instr("_clean", SUMMARY), F.lit(1))
    section = F.col("_clean").substr(start, F.length("_clean"))
    lines = clean.select(*keep, F.posexplode(F.split(section, "\n")).alias("pos", "_line"))
    line = F.col("_line")
    word = reduce(or_, [line.contains(status) for status in STATUSES])
    return lines.where(word & line.rlike(CANDIDATE)).select(
        *keep,
        "pos",
        F.regexp_extract(line, TEST_LINE, 1).alias("test"),
        _status(line).alias("status"),
    )


def parse_log_lines(
    lines: DataFrame, keys: Sequence[str], no: str = "line_no", text: str = "line", together: bool = False
) -> DataFrame:
    """As :func:`parse_test_log` for logs that lie in a table of lines, so that no log has to fit a cell.

    ``keys`` name a log, ``no`` counts its lines. A log's first summary heading is a minimum by key, combined in each
    task; only status lines are joined to it, and those of a hot log are spread. Where no log is hot, ``together`` takes
    the headings along with the status lines in a window by key: the lines are made once, and once they are dealt by
    some of ``keys`` they are not shuffled.
    """
    keys = list(keys)
    has_codes = F.col(text).contains("\x1b")
    clean = lines.select(*keys, F.col(no).alias("pos"), F.when(has_codes, strip_ansi(F.col(text))).otherwise(F.col(text)).alias("_line"))
    line = F.col("_line")
    is_head = line.contains(SUMMARY)
    is_status = reduce(or_, [line.contains(status) for status in STATUSES]) & line.rlike(CANDIDATE)
    if together:
        marked = clean.where(is_head | is_status).withColumn("_found", is_status)
        first = F.min(F.when(is_head, F.col("pos"))).over(Window.partitionBy(*keys))
        present = reduce(and_, [F.col(c).isNotNull() for c in keys])  # a null key names no log, as in the join
        found = marked.withColumn("_head", F.when(present, first)).where("_found")
    else:
        heads = clean.where(is_head).groupBy(*keys).agg(F.min("pos").alias("_head"))
        found = skew_join(clean.where(is_status), heads, keys, "left")
    return found.where("_head IS NULL OR pos > _head").select(
        *keys, (F.col("pos") - F.coalesce("_head", F.lit(0))).alias("pos"), F.regexp_extract(line, TEST_LINE, 1).alias("test"),
        _status(line).alias("status"),
    )


def log_order(batch: Column, pos: Column) -> Column:
    """Order of all lines of an instance: by log, then by place. A log, being one text, has fewer than 2 ** 31 lines."""
    return (batch.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos).cast("decimal(38,0)")


def last_status_per_test(
    outcomes: DataFrame, keys: Sequence[str] = ("instance_id", "phase"), pos: str = "pos"
) -> DataFrame:
    """Status of the last line of every test.

    The status travels as a small number: fixed-width buffers keep this a hash aggregate with
    partial aggregation, where text would force sorting.
    """
    names = F.array(*[F.lit(s) for s in ALL_STATUSES])
    code = F.array_position(names, F.col("status")).cast("int")
    best = outcomes.groupBy(*keys, "test").agg(F.max_by(code, F.col(pos)).alias("_code"))
    return best.select(*keys, "test", F.element_at(names, F.col("_code")).alias("status"))


def last_lines(lines: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """(keys, status, pos) of the last line of every key, one whose ``pos`` is null coming first; a hash aggregate as well."""
    names = F.array(*[F.lit(s) for s in ALL_STATUSES])
    code = F.array_position(names, F.col("status")).cast("int")
    first = F.lit("-" + "9" * 38).cast("decimal(38,0)")
    best = lines.groupBy(*keys).agg(F.max_by(code, F.coalesce(F.col(pos).cast("decimal(38,0)"), first)).alias("_code"), F.max(pos).alias(pos))
    return best.select(*keys, F.element_at(names, F.col("_code")).alias("status"), pos)


def aggregate_param_status(
    outcomes: DataFrame, keys: Sequence[str] = ("instance_id", "phase")
) -> DataFrame:
    """One status per test without its parameters: any failure fails, else any pass passes."""
    bad = F.bool_or(F.col("status").isin("FAILED", "ERROR", "UNKNOWN"))
    good = F.bool_or(F.col("status") == "PASSED")
    flags = outcomes.groupBy(*keys, base_test_name(F.col("test")).alias("base_test")).agg(
        bad.alias("_bad"), good.alias("_good")
    )
    status = F.when(F.col("_bad"), "FAILED").when(F.col("_good"), "PASSED").otherwise("SKIPPED")
    return flags.select(*keys, "base_test", status.alias("status"))


def filter_status_in(
    outcomes: DataFrame,
    statuses: Sequence[str] | None = ("PASSED",),
    keys: Sequence[str] = ("instance_id", "phase"),
) -> DataFrame:
    """Tests (without parameters) whose combined status is wanted; no wish means PASSED."""
    wanted = list(statuses or ("PASSED",))
    combined = aggregate_param_status(outcomes, keys)
    return combined.where(F.col("status").isin(wanted)).select(*keys, "base_test")


def resolve_test_status(
    selectors: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("instance_id",), together: bool = False
) -> DataFrame:
    """Status of every selector: of the very test, else of all its parameters, else UNKNOWN.

    ``outcomes`` has one row per key and test (see :func:`last_status_per_test`). Where no base name is hot, ``together``
    takes both statuses in windows over selectors and outcomes: outcomes are read once, and what is dealt by some of
    ``keys`` alike is not shuffled.
    """
    keys = list(keys)
    if together:
        return _resolved_together(selectors, outcomes, keys)
    exact = outcomes.select(
        *keys, F.col("test").alias("selector"), F.col("status").alias("_exact")
    )
    combined = aggregate_param_status(outcomes, keys).withColumnRenamed("status", "_combined")
    named = selectors.withColumn("base_test", base_test_name(F.col("selector")))
    by_base = [*keys, "base_test"]
    # selectors are few per test but may be many per base name
    asked = named.join(exact, [*keys, "selector"], "left")
    return (
        skew_join(asked, combined, by_base, "left", heavy=heavy_keys(named, by_base))
        .withColumn("status", F.coalesce("_exact", "_combined", F.lit("UNKNOWN")))
        .drop("_exact", "_combined", "base_test")
    )


def _resolved_together(selectors: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "selector", *[c for c in selectors.columns if c not in (*keys, "selector")]]
    asked = selectors.select(*columns, F.col("selector").alias("_test"), F.lit(None).cast("string").alias("_status"), F.lit(True).alias("_asked"))
    types = dict(selectors.dtypes)
    gaps = [F.lit(None).cast(types[c]).alias(c) for c in columns[len(keys) :]]
    seen = outcomes.select(*keys, *gaps, F.col("test").alias("_test"), F.col("status").alias("_status"), F.lit(False).alias("_asked"))
    rows = asked.unionByName(seen).withColumn("_base", base_test_name(F.col("_test")))
    of_test, of_base = Window.partitionBy(*keys, "_base", "_test"), Window.partitionBy(*keys, "_base")
    status = F.col("_status")
    placed = rows.withColumn("_exact", F.max(status).over(of_test)).withColumns({
        "_bad": F.bool_or(status.isin("FAILED", "ERROR", "UNKNOWN")).over(of_base), "_good": F.bool_or(status == "PASSED").over(of_base),
        "_seen": F.bool_or(~F.col("_asked")).over(of_base),
    })
    combined = F.when(F.col("_bad"), "FAILED").when(F.col("_good"), "PASSED").when(F.col("_seen"), "SKIPPED")
    present = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "_test"]])  # null keys match nothing, as in the join
    found = F.when(present, F.coalesce("_exact", combined))
    return placed.where("_asked").select(*columns, F.coalesce(found, F.lit("UNKNOWN")).alias("status"))


def query_tests(
    selectors: DataFrame,
    outcomes: DataFrame,
    statuses: Sequence[str] = ("PASSED",),
    keys: Sequence[str] = ("instance_id",),
    together: bool = False,
) -> DataFrame:
    """Selectors whose status is wanted."""
    return resolve_test_status(selectors, outcomes, keys, together).where(F.col("status").isin(*statuses))


def selector_of(path: Column, name: Column, code_type: Column, change_type: Column) -> Column:
    """Test selector of a changed function or method; null for deletions and classes."""
    method = F.concat(
        path, F.lit("::"), F.substring_index(name, ".", 1), F.lit("::"),
        F.regexp_replace(name, r"^[^.]*\.", ""),
    )
    selector = F.when(code_type == "function", F.concat(path, F.lit("::"), name)).when(
        code_type == "method", method
    )
    return F.when(change_type != "deleted", selector)


def build_test_selectors(symbol_changes: DataFrame) -> DataFrame:
    """Changed test symbols with the ``selector`` to run them by."""
    selector = selector_of(F.col("path"), F.col("name"), F.col("code_type"), F.col("change_type"))
    return symbol_changes.withColumn("selector", selector).where("selector IS NOT NULL")


def assign_batches(
    selectors: DataFrame,
    base_len: int,
    limit: int = 100_000,
    size: int = 250,
    keys: Sequence[str] = ("instance_id",),
    pos: str = "pos",
) -> DataFrame:
    """Add ``batch``: runs of ``size`` selectors where one command would exceed ``limit`` characters."""
    width = F.length("selector") + 1
    placed = numbered(selectors, keys, pos, width)
    batch = F.when(
        F.lit(base_len) + F.col("_total") > limit, F.floor(F.col("_number") / size)
    ).otherwise(F.lit(0))
    return placed.withColumn("batch", batch.cast("bigint")).drop("_number", "_total")
