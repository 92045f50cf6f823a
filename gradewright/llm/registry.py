"""Queries of this subpackage: a name, a plan over the tables of a folder, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts empty: other columns cannot clash with an operator's own."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def row_key(docs: DataFrame) -> Column:
    """A digest of doc_id and text: tells rows apart by content, however often and in whatever order they are read."""
    name = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"], F.lit("")))
    return F.unhex(F.sha1(name.cast("binary")))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (``_row_key``, distinct), with all columns; equal rows once.

    Texts are shuffled once. Equal rows are looked for in the keys first, so that texts are grouped only if there are any.
    """
    key = fresh(docs, "_row_key")
    keyed = docs.withColumn(key, row_key(docs))
    found = keyed.join(kept.select(F.col("_row_key").alias(key)), key, "left_semi")
    keys = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if keys.where("_n > 1").limit(1).count():
        found = found.dropDuplicates([key])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
