"""Column predicates on file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names and file name patterns that mark test code when mining.
TEST_DIRS = ("test", "tests", "testing", "spec", "specs")
TEST_FILES = (r"test_.*\.py$", r".*_test\.py$", r".*_spec\.py$", r"conftest\.py$")
# Folder names searched for a suite, and root folders left out of the search.
SUITE_DIRS = ("tests", "test", "Tests", "TESTS", "unit_tests", "TEST")
SUITE_IGNORED = (".venv", "build")
# Fixed value: the looser rule on whole lower-cased paths, used on patches.
TEST_PATCH = r"test.*\.py$"


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches_any_start(name: Column, patterns: Sequence[str]) -> Column:
    return name.rlike("^(?:" + "|".join(patterns) + ")")


def is_test_path(
    path: Column, dirs: Sequence[str] = TEST_DIRS, patterns: Sequence[str] = TEST_FILES
) -> Column:
    """Mining rule: a path part is a test directory and the file name follows a test pattern."""
    in_dir = F.arrays_overlap(F.split(F.lower(path), "/"), string_array(dirs))
    return F.coalesce(matches_any_start(file_name(path), patterns) & in_dir, F.lit(False))


def is_test_patch(path: Column) -> Column:
    """Patch rule: 'test' anywhere before a '.py' end, in any case (so 'latest.py' counts)."""
    return F.coalesce(F.lower(path).rlike(TEST_PATCH), F.lit(False))
