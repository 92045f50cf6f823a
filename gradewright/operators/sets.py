"""Set algebra on tables by key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def set_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of both."""
    return a.select(*keys).intersect(b.select(*keys))


def union_all(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of both by column name, optionally without repetition."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.distinct() if distinct else both
