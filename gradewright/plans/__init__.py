"""Importing this package registers all queries."""

from . import changes, curation, end_to_end, evaluation, storage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
