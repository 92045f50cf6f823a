"""Importing this module registers all queries of the subpackage."""

from . import (  # noqa: F401
    binary_output,
    exact_dedup,
    fingerprints,
    html_extraction,
    lm_scoring,
    merkle,
    packing,
    pii,
    quality,
    resampling,
    sentencepiece_scan,
    simhash,
    token_counts,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
