"""Connected components of an edge table, wholly distributed: alternating large and small stars.

Hubs cost nothing extra: their minimum is a combined aggregate, and the join that hands it back is
an ordinary shuffled join, whose skewed partitions adaptive execution splits. The edge table is
written to the shared folder after each round, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b), a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(
        F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a").select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b) that is not its own component's smallest.

    Nulls and loops are ignored; the component is its smallest node. Rounds grow with the logarithm
    of the longest path, not with the size of a group.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where(F.col("a") > F.col("b")).distinct(), label)
    seen = None
    while True:
        now = cut_lineage(_stars(now), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
