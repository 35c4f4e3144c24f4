"""Exact similarity search as a blocked matrix product inside each scope.

Both sides are cut into blocks of at most about `block_rows` vectors per scope, so a scope
holding a third of all rows becomes many independent block pairs. Each task multiplies one
block pair and emits only the best rows, never all pairs. In scopes of many blocks a vector meets only
the blocks that can hold a wanted row (see pivots), or with a high threshold only the rows that its sketch
cannot rule out (see sketches). A few queries are sent to the rows instead, which are then not shuffled at all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scoring import SCORE_DIGITS
from memloom.operators import pivots as pv
from memloom.operators import sketches as sk
from memloom.operators.best import Best, add_nearest
from memloom.operators.items import scope_join
from memloom.schemas import EMBEDDING_DIMS, SCOPE
from memloom.session import broadcast_if_small, cut_lineage

BLOCK_ROWS = 8192
#: Scopes of so many blocks on the right are searched by way of pivots; for the k nearest only where there are more
#: blocks than pivots, as a row that meets the home of every pivot is copied once for each.
PIVOT_BLOCKS, NEAREST_BLOCKS = 8, pv.PIVOTS
#: So many queries, and values of their vectors, are sent to all rows.
SCAN_QUERIES, SCAN_VALUES = 1024, 1 << 20
#: Sketches rule out little below this threshold; blocks of them hold so many times the rows of a block of vectors.
SKETCH_FROM, SKETCH_BLOCKS = 0.7, 8
_CHUNK = 1024


def _allowed(types: pa.ChunkedArray, right_types: np.ndarray) -> np.ndarray | None:
    lists = types.to_pylist()
    if not any(lists):
        return None
    return np.stack([
        np.isin(right_types, wanted) if wanted else np.ones(len(right_types), bool)
        for wanted in lists
    ])


def _best_in_block(k: int | None, threshold: float | None, has_types: bool, earlier_only: bool):
    schema = pa.schema([
        ("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64()),
    ])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        left = left.rename_columns([c.removeprefix("l_") for c in left.column_names])
        right = right.sort_by("item_id")
        a, b = pv.unit_rows(left["vector"]), pv.unit_rows(right["vector"])
        ids = np.asarray(left["query_id"].to_pylist(), dtype=object)
        names = np.asarray(right["item_id"].to_pylist(), dtype=object)
        mask = None
        if has_types:
            mask = _allowed(left["types"], np.asarray(right["type"].to_pylist(), dtype=object))
        if earlier_only:
            after = left["last_seq"].to_numpy()
            open_from = left["open_seq"].to_numpy()
            born, dead = right["first_seq"].to_numpy(), right["dead_seq"].to_numpy()
        rows, cols, values = [], [], []
        for start in range(0, len(a), _CHUNK):
            part = slice(start, start + _CHUNK)
            score = np.round(a[part] @ b.T, SCORE_DIGITS)
            if mask is not None:
                score[~mask[part]] = -np.inf
            if earlier_only:
                score[born[None, :] >= after[part, None]] = -np.inf
                score[dead[None, :] < open_from[part, None]] = -np.inf
                score[names[None, :] == ids[part, None]] = -np.inf
            if threshold is not None:
                score[score < threshold] = -np.inf
            if k is not None and k < score.shape[1]:
                # Stable sort over id-ordered columns: equal scores keep id order.
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                r = np.repeat(np.arange(score.shape[0]), top.shape[1])
                c = top.ravel()
            else:
                r, c = np.nonzero(np.isfinite(score))
            v = score[r, c]
            keep = np.isfinite(v)
            rows.append(r[keep] + start)
            cols.append(c[keep])
            values.append(v[keep])
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pa.table(
            {"query_id": pa.array(ids[r], pa.string()), "item_id": pa.array(names[c], pa.string()),
             "score": np.concatenate(values)},
            schema=schema,
        )

    return run


_FOUND = pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64())])


def _objects(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), dtype=object)


def _named(best: Best, ids: np.ndarray) -> pa.Table:
    names = [] if best.tie is None else best.tie
    return pa.table({"query_id": pa.array(ids[best.row], pa.string()), "item_id": pa.array(names, pa.string()), "score": best.score}, schema=_FOUND)


def _nearest_in_block(k: int, has_types: bool):
    """The k nearest of a block pair, without any other condition than types."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _FOUND.empty_table()
        right = right.sort_by("item_id")
        allowed = _allowed(left["l_types"], _objects(right["type"])) if has_types else None
        best = Best(left.num_rows, k)
        add_nearest(best, pv.unit_rows(left["l_vector"]), pv.unit_rows(right["vector"]), _objects(right["item_id"]), allowed)
        return _named(best, _objects(left["l_query_id"]))

    return run


def _scan(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k nearest of each partition of the right side, for a left side of counted, small size."""
    has_types = "types" in left.columns and "type" in right.columns
    asked: dict[tuple, list] = {}
    for q in left.collect():
        asked.setdefault(tuple(q[c] for c in SCOPE), []).append(q)
    held = left.sparkSession.sparkContext.broadcast({scope: (
        np.asarray([q["query_id"] for q in rows], dtype=object),
        pv.unit_rows(pa.chunked_array([pa.array([q["vector"] for q in rows], pa.list_(pa.float64()))])),
        [q["types"] for q in rows] if has_types else None) for scope, rows in asked.items()})

    def run(batches):
        found: dict[tuple, Best] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = pa.Table.from_batches([batch.slice(start, 2048)])
                scopes = list(zip(*[rows[c].to_pylist() for c in SCOPE]))
                for scope in set(scopes) & held.value.keys():
                    mine = rows.filter(pa.array([s == scope for s in scopes])).sort_by("item_id")
                    ids, vectors, types = held.value[scope]
                    allowed = _allowed(pa.chunked_array([pa.array(types, pa.list_(pa.string()))]), _objects(mine["type"])) if has_types else None
                    best = found.setdefault(scope, Best(len(ids), k))
                    add_nearest(best, vectors, pv.unit_rows(mine["vector"]), _objects(mine["item_id"]), allowed)
        for scope, best in found.items():
            yield from _named(best, held.value[scope][0]).to_batches()

    return right.select(*SCOPE, "item_id", *(["type"] if has_types else []), "vector").mapInArrow(run, "query_id string, item_id string, score double")


def _sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(scope, nl, nr): rows of both sides in the scopes that have both."""
    return cut_lineage(left.groupBy(*SCOPE).agg(F.count("*").alias("nl")).join(
        right.groupBy(*SCOPE).agg(F.count("*").alias("nr")), SCOPE))


def _pair_blocks(left: DataFrame, right: DataFrame, sizes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Tag rows with block pair numbers; sides are copied once per opposite block of the scope."""
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block_rows)).cast("int")
    plan = sizes.select(*SCOPE, blocks("nl").alias("nl"), blocks("nr").alias("nr"))
    plan = broadcast_if_small(plan, sizes.count(), 256)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    l = left.join(plan, SCOPE).withColumn("lb", mine("query_id", "nl")).withColumn("rb", every("nr"))
    r = right.join(plan, SCOPE).withColumn("rb", mine("item_id", "nr")).withColumn("lb", every("nl"))
    return l.drop("nl", "nr"), r.drop("nl", "nr")


def _compare(l: DataFrame, r: DataFrame, keys: list[str], k: int | None, threshold: float | None, earlier_only: bool) -> DataFrame:
    has_types = "types" in l.columns and "type" in r.columns
    # Left and right may stem from the same table, so one side gets columns of its own.
    l = l.select(*[F.col(c).alias(f"l_{c}") for c in l.columns])
    plain = k is not None and threshold is None and not earlier_only
    return (
        l.groupBy(*[f"l_{c}" for c in keys]).cogroup(r.groupBy(*keys))
        .applyInArrow(
            _nearest_in_block(k, has_types) if plain else _best_in_block(k, threshold, has_types, earlier_only),
            "query_id string, item_id string, score double",
        )
    )


def _pivot_search(
    left: DataFrame, right: DataFrame, sizes: DataFrame, k: int | None, threshold: float | None, block_rows: int, earlier_only: bool
) -> tuple[DataFrame, DataFrame]:
    """(best rows, pairs compared and pairs in all) of the scopes in sizes(scope, nl, nr)."""
    of = lambda n: sizes.select(*SCOPE, F.col(n).alias("n"))
    keys = [*SCOPE, "home", "lb", "rb"]
    pivots = cut_lineage(pv.choose_pivots(right.join(sizes.select(*SCOPE), SCOPE, "left_semi")), "pivots")
    # A scope without any direction has no pivots: all of it is one home.
    pivots = sizes.select(*SCOPE).join(pivots, SCOPE, "left").withColumn(
        "pivots", F.coalesce("pivots", F.array().cast("array<array<float>>")))
    placed, maps = pv.homes(right, pivots, of("nr"), block_rows)
    asked = left.withColumn("bar", F.lit(threshold).cast("double"))
    plans, found = [], []

    def search(rows: DataFrame) -> DataFrame:
        l, r, plan = pv.met(cut_lineage(rows, "visits"), placed, block_rows)
        plans.append(plan)
        found.append(_compare(l.drop("bar", "seen"), r, keys, k, threshold, earlier_only))
        return found[-1]

    if threshold is None and k is not None:
        # The k-th score in the nearest home is the bar that all other homes have to reach.
        own = cut_lineage(pv.visits(asked, pivots, maps, of("nl"), block_rows, own_only=True), "visits")
        first = cut_lineage(topk_per_query(search(own), k), "first")
        found[-1] = first.drop("rank")
        bars = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        asked = own.withColumn("seen", F.col("homes")[0]).drop("bar", "homes").join(bars, "query_id", "left")
    search(pv.visits(asked, pivots, maps, of("nl"), block_rows))
    every = sizes.agg(F.sum(F.col("nl") * F.col("nr")).alias("pairs"))
    compared = reduce(DataFrame.unionByName, plans).agg(F.sum(F.col("nl") * F.col("nr")).alias("compared"))
    return reduce(DataFrame.unionByName, found), compared.join(F.broadcast(every))


def _sketch_search(
    left: DataFrame, right: DataFrame, sizes: DataFrame, k: int | None, threshold: float, block_rows: int, earlier_only: bool
) -> DataFrame:
    """Best rows at or above the threshold of the scopes in sizes(scope, nl, nr)."""
    inside = sizes.select(*SCOPE)
    left, right = left.join(F.broadcast(inside), SCOPE, "left_semi"), right.join(F.broadcast(inside), SCOPE, "left_semi")
    short = sk.sketch(sk.fit_basis(right, sizes.agg(F.sum("nr")).first()[0]))
    drawn = [cut_lineage(side.withColumn("sketch", short("vector")).drop("vector"), "sketches") for side in (left, right)]
    l, r = _pair_blocks(*drawn, sizes, SKETCH_BLOCKS * block_rows)
    found = cut_lineage(sk.candidates(l, r, [*SCOPE, "lb", "rb"], threshold, earlier_only), "candidates")
    pairs = found.where(F.col("query_id").isNotNull() & F.col("item_id").isNotNull())
    # Only the vectors of rows that are in some pair are dealt.
    n = pairs.count()
    paired = lambda side, key: side.join(broadcast_if_small(pairs.select(key).distinct(), n, 64), key, "left_semi")
    mine = pairs.join(paired(left, "query_id").select("query_id", *SCOPE, "vector"), "query_id")
    theirs = paired(right, "item_id").select("item_id", *SCOPE, F.col("vector").alias("_other"))
    scored = mine.join(theirs, ["item_id", *SCOPE]).select("query_id", "item_id", sk.exact_score(SCORE_DIGITS)("vector", "_other").alias("score"))
    near = scored.where(F.col("score") >= threshold)
    crowd = found.where(F.col("item_id").isNull()).select("query_id").distinct()
    if crowd.isEmpty():
        return near
    # Crowded rows and what they can reach: few rows, of which each block pair again emits only the best.
    met = found.where(F.col("query_id").isNull()).select("item_id").distinct()
    a, b = cut_lineage(left.join(crowd, "query_id", "left_semi"), "crowd"), cut_lineage(right.join(met, "item_id", "left_semi"), "crowd")
    l, r = _pair_blocks(a, b, _sizes(a, b), block_rows)
    more = _compare(l, r, [*SCOPE, "lb", "rb"], k, threshold, earlier_only)
    return near.unionByName(more).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def blocked_similarity(
    left: DataFrame,
    right: DataFrame,
    k: int | None = None,
    threshold: float | None = None,
    block_rows: int = BLOCK_ROWS,
    earlier_only: bool = False,
    pivot_blocks: int | None = None,
) -> DataFrame:
    """(query_id, item_id, score): the block-wise best of right(item_id, vector) for left(query_id, vector).

    Both sides carry a full scope. With k, at most k rows per left row and block survive; cut
    again over blocks by `topk_per_query`. Scopes of `pivot_blocks` blocks or more leave out the blocks
    that can hold nothing wanted; sketches leave out pairs from a quarter as many blocks on.
    """
    sizes = _sizes(left, right)
    if pivot_blocks is None:
        pivot_blocks = NEAREST_BLOCKS if k is not None and threshold is None else PIVOT_BLOCKS
    sketched = threshold is not None and threshold >= SKETCH_FROM and "types" not in left.columns
    most = ((pivot_blocks // 4 if sketched else pivot_blocks) - 1) * block_rows
    large = sizes.where(F.col("nr") > most)
    l, r = _pair_blocks(left, right, sizes.where(F.col("nr") <= most), block_rows)
    small = _compare(l, r, [*SCOPE, "lb", "rb"], k, threshold, earlier_only)
    if large.isEmpty():
        return small
    if sketched:
        return small.unionByName(_sketch_search(left, right, large, k, threshold, block_rows, earlier_only))
    return small.unionByName(_pivot_search(left, right, large, k, threshold, block_rows, earlier_only)[0])


def compared_share(left: DataFrame, right: DataFrame, k: int | None, threshold: float | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(compared, pairs): how many pairs a search by way of pivots multiplies, of all pairs inside the scopes."""
    return _pivot_search(left, right, _sizes(left, right), k, threshold, block_rows, False)[1]


def topk_per_query(scored: DataFrame, k, order=("-score", "item_id"), by: str = "query_id") -> DataFrame:
    """Best k rows per query; the window prunes before its shuffle. k is a number or a column."""
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*columns)))
    return ranked.where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    include_superseded: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Top k embedded items in scope per query by cosine, ties by id.

    queries(query_id, scope, vector[, types]); a null project spans the user's projects. Where no block size is given
    the items are scanned for a few queries, and otherwise blocks of short vectors hold more of them.
    """
    rows = items.where(F.col("embedding").isNotNull())
    if not include_superseded:
        rows = rows.where(F.col("superseded_by").isNull())
    right = rows.select(*SCOPE, "item_id", "type", F.col("embedding").alias("vector"))
    scopes = right.select(*SCOPE).distinct()
    slim = [c for c in ("query_id", *SCOPE, "vector", "types") if c in queries.columns]
    left = scope_join(queries.select(*slim), scopes)
    if block_rows is None:
        left = cut_lineage(left, "asked")
        first = left.select(F.size("vector").alias("dims")).first()
        dims, asked = max(1, first["dims"] if first else 1), left.count()
        if asked <= SCAN_QUERIES and asked * dims <= SCAN_VALUES:
            return topk_per_query(_scan(left, right, k), k)
        block_rows = max(1, BLOCK_ROWS * EMBEDDING_DIMS // dims)
    return topk_per_query(blocked_similarity(left, right, k=k, block_rows=block_rows), k)


def nearest_item(candidates: DataFrame, items: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The best live neighbour of each candidate in its scope."""
    return knn_join(candidates, items, 1, block_rows=block_rows).drop("rank")


def near_dup_join(
    items: DataFrame,
    threshold: float,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each item's closest earlier item in scope at or above the threshold: one row per item.

    items(item_id, scope, seq, embedding). Output grows with the items, not with their pairs.
    """
    slim = items.select(*SCOPE, "item_id", F.col("seq").cast("long").alias("seq"), F.col("embedding").alias("vector"))
    left = slim.select(
        *SCOPE, F.col("item_id").alias("query_id"), "vector",
        F.col("seq").alias("last_seq"), F.lit(0).cast("long").alias("open_seq"),
    )
    right = slim.select(
        *SCOPE, "item_id", "vector", F.col("seq").alias("first_seq"),
        F.lit(2**62).cast("long").alias("dead_seq"),
    )
    best = blocked_similarity(left, right, 1, threshold, block_rows, earlier_only=True)
    return topk_per_query(best, 1).select(
        F.col("query_id").alias("item_id"), F.col("item_id").alias("match_id"), "score"
    )


def lsh_knn_join(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    bucket_length: float = 0.6,
    tables: int = 12,
    distance: float = 1.3,
) -> DataFrame:
    """Approximate kNN: random-projection buckets on unit vectors, exact rescoring.

    queries(query_id, vector) and items(item_id, embedding) of one scope.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from memloom.functions.vectors import l2_normalize

    left = queries.select("query_id", array_to_vector(l2_normalize(F.col("vector"))).alias("v"))
    right = items.select("item_id", array_to_vector(l2_normalize(F.col("embedding"))).alias("v"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=7
    )
    near = lsh.fit(right).approxSimilarityJoin(right, left, distance, "d")
    scored = near.select(
        F.col("datasetB.query_id").alias("query_id"),
        F.col("datasetA.item_id").alias("item_id"),
        F.round(1.0 - F.col("d") * F.col("d") / 2.0, SCORE_DIGITS).alias("score"),
    )
    return topk_per_query(scored, k)


def ivf_knn_join(queries: DataFrame, items: DataFrame, k: int, lists: int = pv.PIVOTS, probes: int = 40, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate kNN: every item lies in the list of its nearest centre, a query meets its `probes` nearest lists.

    queries(query_id, vector) and items(item_id, embedding) of one scope. The centres are the `lists` items with the
    smallest hash of their id, the only sample; a vector is shuffled once for each list that it meets.
    """
    one = {c: F.lit("all") for c in SCOPE}
    left, right = queries.select("query_id", "vector").withColumns(one), items.select("item_id", F.col("embedding").alias("vector")).withColumns(one)
    found = pv.choose_pivots(right, lists).first()
    centres = pv.unit_rows(pa.chunked_array([pa.array(found["pivots"], pa.list_(pa.float64()))])) if found else np.zeros((0, 0))

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array, most: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        if not len(centres):
            return pa.array([[0]] * len(vectors), pa.list_(pa.int32()))
        score = pv.unit_rows(pa.chunked_array([vectors])) @ centres.T
        return pa.array(list(np.argsort(-score, axis=1, kind="stable")[:, :most[0].as_py()].astype(np.int32)), pa.list_(pa.int32()))

    asked = cut_lineage(left.withColumn("homes", nearest("vector", F.lit(probes))), "probes")
    held = cut_lineage(right.withColumn("home", nearest("vector", F.lit(1))[0]), "lists")
    l, r, _ = pv.met(asked, held, block_rows)
    return topk_per_query(_compare(l, r, [*SCOPE, "home", "lb", "rb"], k, None, False), k)


def ann_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search also returned."""
    found = exact.join(
        approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left"
    )
    return found.agg(
        F.count("*").alias("n_exact"),
        F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("ann_recall"),
    )
