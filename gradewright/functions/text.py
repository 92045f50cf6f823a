"""Column functions on release text, versions, references and prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source data was written with: Unicode space plus the four separator controls.
SPACE = r"[\s\x1c-\x1f]"
# The same characters one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Every character sequence that ends a line in an agent log.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (SQL ``trim`` drops blanks only)."""
    return F.trim(text, F.lit(SPACES))


def extract_version(tag: Column) -> Column:
    """First run of dot, dash or underscore separated numbers as an array; null without digits."""
    run = F.regexp_extract(tag, r"(?U)([0-9]+)(?:\s*[.\-_]\s*[0-9]+)*", 0)
    parts = F.regexp_extract_all(run, F.lit("([0-9]+)"), F.lit(1))
    numbers = F.transform(parts, lambda part: part.try_cast("decimal(38,0)"))
    return F.when(F.size(numbers) > 0, numbers)


def version_key(version: Column) -> Column:
    return F.array_join(F.transform(version, lambda part: part.cast("string")), ".")


def extract_pr_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/pull/([0-9]+)", 1), F.lit(""))


def build_pr_links(repo: Column, pr_ids: Column, host: str = "https://github.com") -> Column:
    return F.transform(pr_ids, lambda pr: F.concat(F.lit(f"{host}/"), repo, F.lit("/pull/"), pr))


# Ways in which release text mentions a pull request: #1, PR #1, PR1, pull 1, pull #1, (#1).
PR_REFERENCE = r"(?i)(?:#|\bPR\s*#?|\bpull\s+#?)([0-9]+)"


def pr_references(text: Column) -> Column:
    """Distinct pull request numbers of a text in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PR_REFERENCE), F.lit(1)))


def truncate_readme(readme: Column, n: int = 2000, suffix: str = "...(truncated)") -> Column:
    text = F.coalesce(readme, F.lit(""))
    excerpt = F.concat(
        F.substring(text, 1, n), F.when(F.length(text) > n, F.lit(suffix)).otherwise("")
    )
    block = F.concat(F.lit("Repository Context (README):\n"), excerpt, F.lit("\n\n---\n"))
    return F.when(strip(text) == "", F.lit("")).otherwise(block)


def render_template(template: str, slots: dict[str, Column]) -> Column:
    """Fill the ``{name}`` slots of a template with columns; null columns become empty text."""
    pieces = []
    for part in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", part):
            pieces.append(F.coalesce(slots[part[1:-1]].cast("string"), F.lit("")))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces) if pieces else F.lit("")


def format_cutoff_date(iso: Column) -> Column:
    """Calendar date of an ISO timestamp in its own zone; other text stays as it is, null is ''."""
    day = F.regexp_extract(iso, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[T ])", 1)
    is_date = (day != "") & F.try_to_timestamp(iso).isNotNull()
    return F.when(is_date, day).otherwise(F.coalesce(iso, F.lit("")))


def strip_ansi(log: Column, codes: str = "m") -> Column:
    """Remove terminal escape sequences that end in one of ``codes``."""
    return F.regexp_replace(log, rf"\x1b\[[0-9;]*[{codes}]", "")


def normalise_code(code: Column) -> Column:
    """Stripped non-blank lines; changes of indentation or blank lines do not show."""
    lines = F.transform(F.split(code, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def base_test_name(test: Column) -> Column:
    return F.substring_index(test, "[", 1)


def sort_tests(tests: Column) -> Column:
    return F.array_sort(F.array_distinct(tests))


def encode_test_list(tests: Column) -> Column:
    """Sorted unique names joined by ', '; an empty list is null."""
    return F.nullif(F.array_join(sort_tests(tests), ", "), F.lit(""))


def decode_test_list(text: Column) -> Column:
    """Inverse of :func:`encode_test_list`; null and '' give an empty list."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.split(text, ", "))


def make_instance_id(repo: Column, pr_number: Column) -> Column:
    return F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), pr_number)


def org(repo: Column) -> Column:
    return F.substring_index(repo, "/", 1)


def number(pr_number: Column) -> Column:
    return strip(pr_number).try_cast("bigint")


def image_name(
    repo: Column,
    number: Column,
    docker_image: Column,
    prefix: str = "registry.local/bench",
    local: str = "bench_",
) -> Column:
    """Qualified image of an instance; null when neither an image nor (repo, number) is known.

    ``local`` is the name part that marks an image as belonging to the benchmark; a name with a
    slash that does not start with it is qualified already.
    """
    given = F.nullif(docker_image, F.lit(""))
    named = F.when(
        (F.coalesce(repo, F.lit("")) != "") & (F.coalesce(number, F.lit(0)) != 0),
        F.concat(
            F.lit(local), F.lower(F.replace(repo, F.lit("/"), F.lit("_"))), F.lit(":"),
            number.cast("string"),
        ),
    )
    short = F.coalesce(given, named)
    qualified = short.contains("/") & ~short.startswith(local)
    full = F.when(qualified, short).otherwise(F.concat(F.lit(f"{prefix}/"), short))
    return F.when(short.contains(":"), full)
