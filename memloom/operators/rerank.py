"""Rerankers over candidate rows (query_id, query, item columns, fused)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scoring import recency_decay, stable, type_weight
from memloom.functions.text import jaccard, token_set

Reranker = Callable[[DataFrame], DataFrame]

# The blend of the heuristic reranker.
WEIGHTS = {"fused": 0.55, "coverage": 0.25, "type": 0.1, "recency": 0.1}


def max_fused_norm(candidates: DataFrame) -> DataFrame:
    """Fused score over the best fused score of the query."""
    best = F.max("fused").over(Window.partitionBy("query_id"))
    return candidates.withColumn("fused_norm", F.col("fused") / F.greatest(best, F.lit(2.220446049250313e-16)))


def heuristic_rerank(now: Column, weights: dict[str, float] | None = None) -> Reranker:
    """Blend of fused rank, token overlap, type and recency, multiplied by confidence."""
    w = WEIGHTS if weights is None else weights

    def rerank(candidates: DataFrame) -> DataFrame:
        whole = Window.partitionBy("query_id")
        overlap = jaccard(token_set(F.col("query")), token_set(F.col("content")))
        blend = (
            w["fused"] * F.col("fused_norm")
            + w["coverage"] * overlap
            + w["type"] * type_weight(F.col("type"))
            + w["recency"] * recency_decay(F.col("updated_at"), now)
        )
        scored = stable(blend * F.col("confidence").cast("double"))
        alone = F.count("*").over(whole) <= 1
        changed = max_fused_norm(candidates).withColumn(
            "fused", F.when(alone, F.col("fused")).otherwise(scored)
        )
        order = whole.orderBy(F.desc("fused"), "item_id")
        return changed.withColumn("position", F.row_number().over(order)).drop("fused_norm")

    return rerank


def noop_rerank(candidates: DataFrame) -> DataFrame:
    return candidates
