"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

Columns beside ``doc_id`` and ``text`` go through all stages but the last. Edge cases are those of the operators:
null texts count as empty for every decision and stay null until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewright.llm import exact_dedup, packing, pii, quality, simhash
from gradewright.llm.registry import table, written
from gradewright.llm.tokens import default_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those that are not held out."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: fingerprints of three-word shingles, 3 bits apart at most."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked in their texts, ``n_chars`` counted anew."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences."""
    return packing.pack(written(packing.pieces(docs, default_path()), "pieces"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("personal_data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
