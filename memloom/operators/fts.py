"""Full-text ranking: postings, OR queries and closed-form cover density.

Matches are scored where the item is: the postings that some query asks for are dealt by item, the queries'
terms are sent to all of them (while their checked size allows), and each partition hands on no more than its own
best k rows of a query. A term that every item holds costs work in every partition and no shuffle.

Many queries would match most items of their scope, so they are scored as products of blocks instead: an item is a row
of term counts, a query a row of ones, and no match becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import query_terms, tokenize
from memloom.operators import best
from memloom.operators.embed import token_counts, token_lists
from memloom.operators.items import live_filter, scope_join, type_allowed
from memloom.operators.knn import _allowed, _objects, _pair_blocks, _sizes, topk_per_query
from memloom.schemas import SCOPE
from memloom.session import BROADCAST_BYTES, cut_lineage

TERM_BYTES = 200
#: Scores, one for each query and item, that a partition of items may come to hold at once.
SCORES = 1 << 20

#: From so many queries on, blocks of so many queries and items are scored as products.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 8192
#: Terms with at least one match in so many pairs are multiplied, others are added match by match; terms of one product, matches added at once.
_RARE, _TERMS, _MATCHES = 150, 4096, 1 << 21

# Fixed value: weight of one match.
MATCH_WEIGHT = 0.1

_META = ["type", "superseded_by", "updated_at"]


def postings(items: DataFrame, wanted: DataFrame | None = None, by_item: bool = False, parts: int | None = None) -> DataFrame:
    """Inverted index rows (scope, token, item_id, tf) with what ranking and filters need.

    With `wanted` tokens only their rows are counted, before anything is shuffled; `by_item` deals them so
    that all of an item lie in one partition (of `parts`, where a number is given).
    """
    keys = [*SCOPE, "item_id", *_META]
    return token_counts(items.select(*keys, "content"), "content", keys, wanted, "item_id" if by_item else None, parts)


def _parts(df: DataFrame, n_items: int, n_queries: int) -> int | None:
    """Partitions that no more than SCORES scores fall to; none where the planner's own are enough.

    Postings are small beside the scores that they give, so partitions of a set size would come to hold ever more of them.
    """
    wanted = -(-n_items * n_queries // SCORES)
    return max(wanted, df.sparkSession.sparkContext.defaultParallelism) if wanted > 1 else None


def terms_of(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per distinct term of each query (of its first `limit` tokens, where one is given)."""
    terms = F.array_distinct(query_terms(tokenize(F.col("query")), limit))
    keep = ["query_id", *SCOPE] + [c for c in ("types",) if c in queries.columns]
    return queries.select(*keep, F.explode(terms).alias("token"))


def match_terms(queries: DataFrame, index: DataFrame, include_superseded: bool = False, small: bool = False) -> DataFrame:
    """(query, item, token, tf) for every posting a query's terms reach in scope; `small` terms are broadcast."""
    terms = terms_of(queries)
    matched = scope_join(F.broadcast(terms) if small else terms, live_filter(index, include_superseded), on=("token",))
    if "types" in terms.columns:
        matched = matched.where(type_allowed(F.col("types"), F.col("type")))
    return matched


def fts_scores(
    queries: DataFrame, index: DataFrame, rank: str = "cover_density", include_superseded: bool = False, max_positions: int | None = None,
    small: bool = False,
) -> DataFrame:
    """Score per (query, item). rank: cover_density, coverage (terms matched) or idf.

    Every place of a term counts unless max_positions bounds them per term. With `small` queries and an index
    dealt by item nothing but the document counts of idf is shuffled.
    """
    matched = match_terms(queries, index, include_superseded, small)
    positions = F.col("tf") if max_positions is None else F.least(F.col("tf"), F.lit(max_positions))
    if rank == "cover_density":
        score = F.sum(positions) * MATCH_WEIGHT
    elif rank == "coverage":
        score = F.count("*").cast("double")
    elif rank == "idf":
        # Counted by a combined aggregate: a frequent word's postings need not meet in one task.
        df = matched.groupBy("query_id", "token").agg(F.count("*").alias("df"))
        # One row per term of a query at most.
        matched = matched.join(F.broadcast(df) if small else df, ["query_id", "token"])
        score = F.round(F.sum(1.0 / F.log2(F.col("df") + 1.0)), 9)
    else:
        raise ValueError(f"unknown rank {rank}")
    return matched.groupBy("query_id", "item_id").agg(
        score.cast("double").alias("score"), F.first("updated_at").alias("updated_at")
    )


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of all values of a list column."""
    values = lists.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return np.repeat(np.arange(len(values)), pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)), values.flatten()


def _matches(q_row: np.ndarray, q_term: np.ndarray, i_row: np.ndarray, i_term: np.ndarray, tf: np.ndarray, shape: tuple[int, int], terms: int, kind) -> np.ndarray:
    """Sum of tf over the terms that a query and an item share, for all pairs; q_term ascends."""
    nq, ni = np.bincount(q_term, minlength=terms), np.bincount(i_term, minlength=terms)
    pairs = nq * ni
    score = np.zeros(shape, kind)
    often = np.nonzero(pairs * _RARE > shape[0] * shape[1])[0]
    for start in range(0, len(often), _TERMS):
        at = np.full(terms, -1)
        at[often[start:start + _TERMS]] = np.arange(len(often[start:start + _TERMS]))
        q, i = at[q_term] >= 0, at[i_term] >= 0
        asked, held = np.zeros((shape[0], at.max() + 1), kind), np.zeros((at.max() + 1, shape[1]), kind)
        asked[q_row[q], at[q_term[q]]] = 1
        held[at[i_term[i]], i_row[i]] = tf[i]
        score += asked @ held
    rare = pairs > 0
    rare[often] = False
    e = np.nonzero(rare[i_term])[0]
    n, first = nq[i_term[e]], np.concatenate(([0], np.cumsum(nq)))[i_term[e]]
    ends = np.cumsum(n)
    start = 0
    while start < len(e):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _MATCHES, side="right")))
        m = n[start:stop]
        place = np.repeat(first[start:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cell = q_row[place] * shape[1] + np.repeat(i_row[e[start:stop]], m)
        score += np.bincount(cell, np.repeat(tf[e[start:stop]], m), minlength=score.size).reshape(shape).astype(kind)
        start = stop
    return score


def _best_matches(k: int, count_once: bool, has_types: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("updated_at", "descending"), ("item_id", "ascending")])
        q_row, words = _flat(left["l_tokens"])
        vocabulary = words.unique()
        i_row, held = _flat(right["token"])
        known = pc.index_in(held, value_set=vocabulary)
        keep = pc.is_valid(known).to_numpy(zero_copy_only=False)
        i_row, i_term = i_row[keep], known.drop_null().to_numpy().astype(np.int64)
        tf = np.ones(len(i_row)) if count_once else _flat(right["tf"])[1].to_numpy(zero_copy_only=False)[keep].astype(np.float64)
        # Single precision holds whole numbers exactly up to this sum.
        kind = np.float32 if not len(i_row) or np.bincount(i_row, tf).max() < 2 ** 24 else np.float64
        q_term = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        allowed = _allowed(left["l_types"], _objects(right["type"])) if has_types else None
        found = []
        for start in range(0, left.num_rows, best.ROWS):
            stop = min(start + best.ROWS, left.num_rows)
            mine = np.nonzero((q_row >= start) & (q_row < stop))[0]
            mine = mine[np.argsort(q_term[mine], kind="stable")]
            part = best.Best(stop - start, k)
            for low in range(0, right.num_rows, best.COLUMNS):
                high = min(low + best.COLUMNS, right.num_rows)
                theirs = slice(*np.searchsorted(i_row, (low, high)))
                score = _matches(q_row[mine] - start, q_term[mine], i_row[theirs] - low, i_term[theirs], tf[theirs], (stop - start, high - low), len(vocabulary), kind)
                score[score <= 0] = -np.inf
                if allowed is not None:
                    score[~allowed[start:stop, low:high]] = -np.inf
                # Later columns lose ties, so they have to be above the bar.
                r, c = best.candidates(score, np.nextafter(part.bar, np.inf), k) if np.isfinite(part.bar).all() else best.candidates(score, part.bar, k)
                part.add(*_first_of(stop - start, k, r, c, score[r, c].astype(np.float64), low))
            if part.tie is not None:
                found.append((part.row + start, part.tie, part.score))
        row, column, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 3))
        return pa.table({"query_id": left["l_query_id"].take(pa.array(row)), "item_id": right["item_id"].take(pa.array(column)),
                         "matches": pa.array(score, pa.float64()), "updated_at": right["updated_at"].take(pa.array(column))})

    return run


def _first_of(rows: int, k: int, r: np.ndarray, c: np.ndarray, score: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c, score = best._cut(rows, k, r, c, score)
    return r, score, c + low


def _block_branch(queries: DataFrame, items: DataFrame, k: int, rank: str, include_superseded: bool, index: DataFrame | None) -> DataFrame:
    """The same as fts_branch for many queries, by blocks of a scope's queries and items."""
    meta = [*SCOPE, "item_id", *_META]
    if index is None:
        held = live_filter(items.select(*meta, "content"), include_superseded)
    else:
        listed = live_filter(index.select(*meta, "token", "tf"), include_superseded).groupBy(*meta).agg(F.collect_list(F.struct("token", F.col("tf").cast("int").alias("tf"))).alias("t"))
        held = listed.select(*meta, F.col("t.token").alias("token"), F.col("t.tf").alias("tf"))
    types = ["types"] if "types" in queries.columns else []
    asked = queries.select("query_id", *SCOPE, *types, F.array_distinct(tokenize(F.col("query"))).alias("tokens")).where(F.size("tokens") > 0)
    left = cut_lineage(scope_join(asked, held.select(*SCOPE).distinct()), "asked")
    sizes = _sizes(left, held)
    # Scopes that nobody asks are left out before their texts are read.
    held = held.join(F.broadcast(sizes.select(*SCOPE)), SCOPE, "left_semi")
    if index is None:
        held = held.withColumn("t", token_lists()(tokenize(F.col("content")))).select(*meta, "t.token", "t.tf")
    l, r = _pair_blocks(left, held.drop("superseded_by"), sizes, BLOCK_ROWS)
    l = l.select(*[F.col(c).alias(f"l_{c}") for c in l.columns])
    keys = [*SCOPE, "lb", "rb"]
    best_of = l.groupBy(*[f"l_{c}" for c in keys]).cogroup(r.groupBy(*keys)).applyInArrow(
        _best_matches(k, rank == "coverage", bool(types)), "query_id string, item_id string, matches double, updated_at timestamp")
    score = F.col("matches") if rank == "coverage" else F.col("matches") * MATCH_WEIGHT
    scored = best_of.select("query_id", "item_id", F.round(score.cast("double"), 9).alias("score"), "updated_at")
    return topk_per_query(scored, k, ("-score", "-updated_at", "item_id")).select("query_id", "item_id", "score", "rank")


def fts_branch(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    rank: str = "cover_density",
    include_superseded: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Top k items per query by term matches, then recency, then id. Pass a stored index to skip the scan.

    At most k rows of a query leave a partition of the items, as long as the terms fit a broadcast, and partitions
    are as many as the scores of all queries need. From BLOCK_QUERIES queries on, they are scored by blocks (idf apart).
    """
    if rank != "idf" and queries.count() >= BLOCK_QUERIES:
        return _block_branch(queries, items, k, rank, include_superseded, index)
    terms = terms_of(queries)
    n_terms, n_queries = terms.agg(F.count("*"), F.count_distinct("query_id")).first()
    small = n_terms * TERM_BYTES <= BROADCAST_BYTES
    if index is None:
        held = postings(items, terms, by_item=small, parts=_parts(items, items.count(), n_queries) if small else None)
    elif small:
        columns = [*SCOPE, "token", "item_id", "tf", *_META]
        asked = F.broadcast(terms.select("token").distinct())
        parts = _parts(index, index.agg(F.approx_count_distinct("item_id")).first()[0], n_queries)
        held = index.select(*columns).join(asked, "token", "left_semi").repartition(*([parts] if parts else []), "item_id")
    else:
        held = index
    scores = fts_scores(queries, held, rank, include_superseded, small=small).withColumn("score", F.round("score", 9))
    top = topk_per_query(scores, k, ("-score", "-updated_at", "item_id"))
    return top.select("query_id", "item_id", "score", "rank")
