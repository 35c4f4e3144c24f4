"""Reciprocal-rank fusion of branches and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scoring import rrf_score
from memloom.operators.knn import topk_per_query
from memloom.schemas import BRANCH_WEIGHTS, RRF_K

FUSED_DIGITS = 12


def rank_in_branch(scored: DataFrame, order: tuple[str, ...] = ("-score", "item_id"), recent: str = "updated_at") -> DataFrame:
    """1-based rank per query and branch. Full-text ties go to the newest, where the hits tell how recent they are."""
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    if recent in scored.columns:
        newest = F.desc(F.when(F.col("branch") == "fts", F.col(recent)))
        columns.insert(next((i + 1 for i, c in enumerate(order) if c == "-score"), 0), newest)
    return scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(*columns))
    )


def union_branches(branches: dict[str, DataFrame]) -> DataFrame:
    """Long form (query_id, branch, item_id, rank, score)."""
    named = [
        hits.select("query_id", F.lit(name).alias("branch"), "item_id",
                    F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
        for name, hits in branches.items()
    ]
    return reduce(DataFrame.unionByName, named)


def weight_of(weights: dict[str, float]):
    column = F.lit(1.0)
    for name, weight in weights.items():
        column = F.when(F.col("branch") == name, F.lit(float(weight))).otherwise(column)
    return column


def rrf_fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, item_id, fused, ranks, position), ties by id."""
    score = rrf_score(weight_of(BRANCH_WEIGHTS if weights is None else weights), F.col("rank"), k)
    fused = hits.groupBy("query_id", "item_id").agg(
        F.round(F.sum(score), FUSED_DIGITS).alias("fused"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "rank")))).alias("ranks"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "item_id")
    return fused.withColumn("position", F.row_number().over(order))


def shortlist(fused: DataFrame, limit: int) -> DataFrame:
    return topk_per_query(fused.drop("position"), limit, ("-fused", "item_id")).withColumnRenamed("rank", "position")


def fusion_report(
    queries: DataFrame, hits: DataFrame, status: DataFrame, branches: list[str] | None = None, k: int = RRF_K
) -> DataFrame:
    """Per query: hits per branch, degraded branches, and why.

    status(query_id, branch, unavailable_reason, degraded_reason) may omit branches.
    """
    names = list(BRANCH_WEIGHTS) if branches is None else branches
    skeleton = queries.select("query_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("branch"))
    counts = hits.groupBy("query_id", "branch").agg(F.count("*").alias("n"))
    rows = (
        skeleton.join(counts, ["query_id", "branch"], "left")
        .join(status, ["query_id", "branch"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    nothing = F.when(F.col("n") == 0, F.coalesce("degraded_reason", F.lit("no hits")))
    rows = rows.withColumn("reason", F.coalesce("unavailable_reason", nothing, "degraded_reason"))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("branch"))
    listed = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(order.alias("o"), "branch", "reason"))))
    grouped = rows.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "n")))).alias("branches"),
        listed.alias("_d"),
    )
    return grouped.select(
        "query_id", "branches",
        F.transform("_d", lambda d: d["branch"]).alias("degraded"),
        F.map_from_entries(F.transform("_d", lambda d: F.struct(d["branch"], d["reason"]))).alias("reasons"),
        F.lit(k).alias("k"),
    )


def total_and_omitted(fused: DataFrame, kept: DataFrame, packed_omitted: DataFrame) -> DataFrame:
    """Hits found per query, and how many the caller does not see."""
    totals = fused.groupBy("query_id").agg(F.count("*").alias("total"))
    shown = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    joined = totals.join(shown, "query_id", "left").join(packed_omitted, "query_id", "left")
    dropped = F.col("total") - F.coalesce("kept", F.lit(0))
    return joined.select(
        "query_id", "total",
        (F.greatest(F.lit(0), dropped) + F.coalesce("packed_omitted", F.lit(0))).alias("omitted"),
    )


def hydrate(hits: DataFrame, visible_items: DataFrame) -> DataFrame:
    """Hits with their item rows; ids that are no longer in scope drop out."""
    return hits.join(visible_items, "item_id")
