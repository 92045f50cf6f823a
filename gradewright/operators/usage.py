"""Token usage from run logs.

A log is one text cell, so every parser is a column expression on it: no shuffle, no extra rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, let, strip, strip_ansi

CODES = "mGKHF"
USAGE = "struct<input bigint, output bigint, total bigint>"


def _count(json: Column, path: str) -> Column:
    """Whole number at a path of parsed JSON: a number, or text of digits."""
    return F.try_variant_get(json, path, "bigint")


def _usage(inp: Column, out: Column, total: Column) -> Column:
    return F.struct(inp.alias("input"), out.alias("output"), total.alias("total")).cast(USAGE)


def _events(clean: Column) -> Column:
    """Parsed JSON object lines of a log in order; lines that do not parse are left out."""
    lines = F.transform(F.split(clean, LINE_BREAK), strip)
    objects = F.filter(lines, lambda line: line.startswith("{") & line.endswith("}"))
    return F.filter(F.transform(objects, F.try_parse_json), lambda event: event.isNotNull())


def usage_table_box(log: Column) -> Column:
    """Rows of a box-drawn table after 'Execution Summary'; the last row of a kind wins."""

    def read(clean: Column) -> Column:
        start = F.instr(clean, "Execution Summary")
        section = F.when(start > 0, clean.substr(start, F.length(clean)))

        def last(kind: str) -> Column:
            row = rf"(?m)^[^\S\n]*│ {kind}\s*│\s*([0-9]+)"
            hits = F.regexp_extract_all(section, F.lit(row), F.lit(1))
            return F.element_at(F.when(F.size(hits) > 0, hits), -1).try_cast("bigint")

        return _usage(last("Input Tokens"), last("Output Tokens"), last("Total Tokens"))

    return let(strip_ansi(log), read)


def usage_last_json(log: Column) -> Column:
    """The last JSON line with ``usage`` counts; the total takes a missing side as 0."""

    def pair(event: Column) -> Column:
        return F.struct(
            _count(event, "$.usage.input_tokens").alias("i"),
            _count(event, "$.usage.output_tokens").alias("o"),
        )

    def read(seen: Column) -> Column:
        last = F.element_at(F.when(F.size(seen) > 0, seen), -1)
        total = F.coalesce(last["i"], F.lit(0)) + F.coalesce(last["o"], F.lit(0))
        return _usage(last["i"], last["o"], F.when(F.size(seen) > 0, total))

    pairs = F.transform(_events(strip_ansi(log, CODES)), pair)
    return let(F.filter(pairs, lambda p: p["i"].isNotNull() | p["o"].isNotNull()), read)


# Places and names under which event lines report counts, in order of preference.
EVENT_PLACES = ("usage", "metrics", "token_usage")
INPUT_NAMES = ("prompt_tokens", "input_tokens", "total_input_tokens")
OUTPUT_NAMES = ("completion_tokens", "output_tokens", "total_output_tokens")


def usage_sum_json(log: Column) -> Column:
    """Sum over all JSON lines of the first place with counts; null when no line has any."""

    def pick(event: Column, place: str, names: tuple[str, ...]) -> Column:
        # a zero falls through to the next name, only the last may be zero
        counts = [_count(event, f"$.{place}.{name}") for name in names]
        return F.coalesce(*[F.nullif(c, F.lit(0)) for c in counts[:-1]], counts[-1])

    def of_event(event: Column) -> Column:
        pairs = F.array(*[
            F.struct(
                pick(event, place, INPUT_NAMES).alias("i"),
                pick(event, place, OUTPUT_NAMES).alias("o"),
            )
            for place in EVENT_PLACES
        ])
        return F.get(F.filter(pairs, lambda p: p["i"].isNotNull() | p["o"].isNotNull()), F.lit(0))

    zero = F.lit(0).cast("bigint")

    def total(seen: Column, side: str) -> Column:
        summed = F.aggregate(seen, zero, lambda acc, p: acc + F.coalesce(p[side], zero))
        return F.when(F.size(seen) > 0, summed)

    def read(seen: Column) -> Column:
        inp, out = total(seen, "i"), total(seen, "o")
        return _usage(inp, out, inp + out)

    found = F.transform(_events(strip_ansi(log, CODES)), of_event)
    return let(F.filter(found, lambda p: p.isNotNull()), read)


# Flat names used where a summary has no per-model counts.
FLAT_INPUT = ("inputTokenCount", "inputTokens", "input_tokens")
FLAT_OUTPUT = ("outputTokenCount", "outputTokens", "output_tokens", "candidatesTokenCount")
FLAT_TOTAL = ("totalTokenCount", "totalTokens", "total_tokens")


def usage_model_stats(log: Column) -> Column:
    """Per-model counts of the last JSON line (else of the whole log as one document), summed."""
    zero = F.lit(0).cast("bigint")

    def document(clean: Column) -> Column:
        def last(events: Column) -> Column:
            whole = F.try_parse_json(strip(clean))
            return F.when(F.size(events) > 0, F.element_at(events, -1)).otherwise(whole)

        return let(_events(clean), last)

    def per_model(models: Column) -> Column:
        def total(name: str) -> Column:
            return F.nullif(
                F.aggregate(
                    models, zero, lambda acc, m: acc + F.coalesce(_count(m, f"$.tokens.{name}"), zero)
                ),
                F.lit(0),
            )

        i, c, t = total("input"), total("candidates"), total("total")
        both = F.coalesce(i, zero) + F.coalesce(c, zero)
        return _usage(i, c, F.coalesce(t, F.nullif(both, F.lit(0))))

    def flat(event: Column) -> Column:
        i, o, t = (
            F.coalesce(*[_count(event, f"$.stats.{name}") for name in names])
            for names in (FLAT_INPUT, FLAT_OUTPUT, FLAT_TOTAL)
        )
        return _usage(i, o, F.coalesce(t, i + o))

    def read(event: Column) -> Column:
        models = F.map_values(F.try_variant_get(event, "$.stats.models", "map<string, variant>"))
        return let(
            models, lambda m: F.when(F.size(m) > 0, per_model(m)).otherwise(flat(event))
        )

    return let(let(strip_ansi(log, CODES), document), read)


Parser = Callable[[Column], Column]


def token_usage(agent_logs: DataFrame, parser: Parser) -> DataFrame:
    """(agent, instance_id, input, output, total) of every log by one parser."""
    return agent_logs.select("agent", "instance_id", parser(F.col("log")).alias("_u")).select(
        "agent", "instance_id", "_u.*"
    )


def token_usage_table_box(agent_logs: DataFrame) -> DataFrame:
    return token_usage(agent_logs, usage_table_box)


def token_usage_last_json(agent_logs: DataFrame) -> DataFrame:
    return token_usage(agent_logs, usage_last_json)


def token_usage_sum_json(agent_logs: DataFrame) -> DataFrame:
    return token_usage(agent_logs, usage_sum_json)


def token_usage_model_stats(agent_logs: DataFrame) -> DataFrame:
    return token_usage(agent_logs, usage_model_stats)


def token_usage_by_agent(
    agent_logs: DataFrame, parsers: Mapping[str, Parser], on_unknown: str = "error"
) -> DataFrame:
    """Every log by the parser registered for its agent, in one pass over the logs.

    An agent without parser ends the job, or gives null counts with ``on_unknown='null'``.
    """
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("no usage parser for agent "), F.col("agent"))).cast(USAGE)
    else:
        unknown = F.lit(None).cast(USAGE)
    cases = reduce(
        lambda case, item: case.when(F.col("agent") == item[0], item[1](F.col("log"))),
        list(parsers.items())[1:],
        _first_case(parsers),
    )
    return agent_logs.select("agent", "instance_id", cases.otherwise(unknown).alias("_u")).select(
        "agent", "instance_id", "_u.*"
    )


def _first_case(parsers: Mapping[str, Parser]) -> Column:
    agent, parser = next(iter(parsers.items()))
    return F.when(F.col("agent") == agent, parser(F.col("log")))


def token_totals(usage_events: DataFrame) -> DataFrame:
    """Sums per run; null where nothing was seen."""
    return usage_events.groupBy("agent", "instance_id").agg(
        *[F.sum(c).alias(c) for c in ("input", "output", "total")]
    )


def last_usage_event(lines: DataFrame) -> DataFrame:
    """The latest event of every run that has an input or an output count."""
    seen = lines.where("input IS NOT NULL OR output IS NOT NULL")
    return seen.groupBy("agent", "instance_id").agg(
        F.max("pos").alias("pos"),
        F.max_by("input", "pos").alias("input"),
        F.max_by("output", "pos").alias("output"),
    ).withColumn("total", F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)))
