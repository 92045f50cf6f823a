"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) for every end of the links ``a``, ``b``.

    In each round every node moves to the smallest of itself and its neighbours; links are named anew by where their
    ends went, and those within one node go. The smallest node of a component never moves. Rounds are about the
    logarithm of the longest way; each is written to the shared folder. Links that join equal ends count for
    nothing; repeated links and both directions are allowed.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("_to")), "moves")
        jumps = moves.select(F.col("a").alias("_to"), F.col("_to").alias("_next"))
        moved = written(moves.join(jumps, "_to").select(F.col("a").alias("_from"), F.col("_next").alias("_to")), "jumps")
        if labels is None:
            labels = moved.select(F.col("_from").alias("node"), F.col("_to").alias("component"))
        else:
            labels = written(
                labels.join(moved, labels["component"] == moved["_from"], "left").select(
                    "node", F.coalesce("_to", "component").alias("component")
                ),
                "labels",
            )
        ends = edges.join(moved, edges["a"] == moved["_from"]).select(F.col("_to").alias("a"), "b")
        ends = ends.join(moved, ends["b"] == moved["_from"]).select("a", F.col("_to").alias("b")).where("a <> b")
        edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
