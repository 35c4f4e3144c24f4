"""Score formulas used by fusion, graph ranking, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.schemas import RRF_K, TYPE_WEIGHTS

HALF_LIFE_DAYS = 180

# Scores are rounded before they are ranked: a distributed sum has no fixed order
# of additions, and ranks must not depend on it.
SCORE_DIGITS = 9


def stable(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def recency_decay(timestamp: Column, now: Column) -> Column:
    """Two to the minus age over the half-life; a future timestamp counts as fresh."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(timestamp.cast("timestamp"))
    days = F.greatest(F.lit(0), seconds) / F.lit(86_400_000_000.0)
    return F.pow(F.lit(2.0), -days / F.lit(float(HALF_LIFE_DAYS)))


def type_weight(type_: Column) -> Column:
    pairs = [F.lit(x) for name, weight in TYPE_WEIGHTS.items() for x in (name, weight / 10)]
    return F.element_at(F.create_map(*pairs), type_)


def rrf_score(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    return weight / (rank + k)


def hop_score(hop: Column) -> Column:
    return F.lit(1.0) / (hop + 1)
