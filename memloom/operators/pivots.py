"""Which blocks of a large scope a vector has to meet: pivots and the triangle inequality.

A scope's vectors are dealt to the nearest of its pivots, a few of its own rows. For every such home the least and
greatest distance of its rows to every pivot is known; by the triangle inequality a query whose
distance to some pivot lies farther outside that range than it may be from a wanted row can leave the whole
home out. With a threshold the reach is fixed; for the k nearest a query first meets its own home, and
its k-th score there is the bar for all others. Bounds are inclusive and a little generous, so the result is
that of all pairs. Vectors of length zero have no direction: they meet everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memloom.schemas import SCOPE
from memloom.session import cut_lineage

PIVOTS = 64
#: Room for rounded scores and for roots of small differences.
SLACK = 1e-6


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column scaled to length one; those of length zero stay zero."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    lengths[lengths == 0] = np.inf
    return matrix / lengths[:, None]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


def choose_pivots(right: DataFrame, most: int = PIVOTS) -> DataFrame:
    """(scope, pivots): in each scope the vectors, not zero, of up to `most` rows with the smallest hash of their id."""
    known = right.where(F.exists("vector", lambda x: x != 0)).select(*SCOPE, "vector", F.xxhash64("item_id").alias("h"), "item_id")
    first = Window.partitionBy(*SCOPE).orderBy("h", "item_id")
    chosen = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    return chosen.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("n", "vector"))).alias("p")).select(
        *SCOPE, F.col("p.vector").alias("pivots"))


def _chunked(rows: DataFrame, key: str, sizes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a chunk number, and (scope, chunk) of all chunks; sizes(scope, n)."""
    chunks = sizes.select(*SCOPE, F.ceil(F.col("n") / block_rows).cast("int").alias("chunks"))
    dealt = rows.join(chunks, SCOPE).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), key), F.col("chunks")).cast("int")).drop("chunks")
    return dealt, chunks.select(*SCOPE, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))


def _apart(df: DataFrame, prefix: str) -> DataFrame:
    """Columns of its own: both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _grouped(rows: DataFrame, other: DataFrame, run, schema: T.StructType) -> DataFrame:
    keys = [*SCOPE, "chunk"]
    return rows.groupBy(*keys).cogroup(_apart(other, "o_").groupBy(*[f"o_{k}" for k in keys])).applyInArrow(run, schema)


def _pivot_matrix(table: pa.Table) -> np.ndarray:
    nested = pa.chunked_array([table["o_pivots"].combine_chunks().flatten()]) if table.num_rows else pa.chunked_array([], pa.list_(pa.float32()))
    return unit_rows(nested)


def homes(right: DataFrame, pivots: DataFrame, sizes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their home, map of each scope). Zero vectors live in home -1.

    The map holds per scope its homes with their rows and their least and greatest distance to each pivot.
    """
    dealt, chunks = _chunked(right, "item_id", sizes, block_rows)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*right.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("low", numbers), T.StructField("high", numbers)])
    # The rows of the map carry no row of the table.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["chunk"])
        if not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        vectors, centres = unit_rows(rows["vector"]), _pivot_matrix(told)
        zero = ~vectors.any(axis=1)
        far = _distances(vectors, centres) if len(centres) else np.zeros((len(vectors), 0))
        home = np.where(zero, -1, far.argmin(axis=1) if far.shape[1] else -1).astype(np.int32)
        empty = lambda kind: pa.nulls(rows.num_rows, kind)
        kept = rows.append_column("home", pa.array(home)).append_column("n", empty(pa.int64())).append_column(
            "low", empty(pa.list_(pa.float64()))).append_column("high", empty(pa.list_(pa.float64())))
        found = np.unique(home)
        summary = {c: [rows[c][0].as_py()] * len(found) for c in SCOPE}
        summary |= {"home": found.tolist(), "n": [int((home == h).sum()) for h in found],
                    "low": [far[home == h].min(axis=0).tolist() for h in found], "high": [far[home == h].max(axis=0).tolist() for h in found]}
        fields = pa.schema([pa.field(f.name, f.type) for f in kept.schema])
        more = pa.table([pa.array(summary.get(f.name, [None] * len(found)), f.type) for f in fields], schema=fields)
        return pa.concat_tables([pa.Table.from_arrays(kept.columns, schema=fields), more])

    measured = cut_lineage(_grouped(dealt, chunks.join(pivots, SCOPE), run, schema), "homes")
    parts = measured.where(F.col("n").isNotNull())
    total = parts.groupBy(*SCOPE, "home").agg(F.sum("n").alias("n"))
    ends = parts.select(*SCOPE, "home", F.posexplode(F.arrays_zip("low", "high")).alias("p", "e")).groupBy(*SCOPE, "home", "p").agg(
        F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    listed = ends.groupBy(*SCOPE, "home").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("e"))
    each = total.join(listed, [*SCOPE, "home"], "left").withColumns({"low": F.col("e.low"), "high": F.col("e.high")})
    maps = each.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("home", "n", "low", "high"))).alias("homes"))
    return measured.where(F.col("n").isNull()).drop("n", "low", "high"), cut_lineage(maps, "home-maps")


def visits(left: DataFrame, pivots: DataFrame, maps: DataFrame, sizes: DataFrame, block_rows: int, own_only: bool = False) -> DataFrame:
    """Left rows (vector, bar: the least wanted score, null for any) with `homes`, those that they have to meet.

    `own_only` names just the nearest home; otherwise rows that carry `seen` leave that home out.
    """
    schema = T.StructType([*left.schema.fields, T.StructField("homes", T.ArrayType(T.IntegerType()))])
    dealt, chunks = _chunked(left, "query_id", sizes, block_rows)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["chunk"])
        if not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        vectors, centres, known = unit_rows(rows["vector"]), _pivot_matrix(told), told["o_homes"][0].as_py()
        names = np.array([h["home"] for h in known], dtype=np.int32)
        ranged = names >= 0
        least = np.zeros((len(vectors), len(names)))
        if ranged.any():
            far = _distances(vectors, centres)
            low, high = (np.array([h[end] for h in known if h["home"] >= 0]) for end in ("low", "high"))
            # One pivot at a time keeps the work at rows x homes.
            bound = np.zeros((len(vectors), ranged.sum()))
            for p in range(far.shape[1]):
                np.maximum(bound, np.maximum(far[:, p:p + 1] - high[:, p], low[:, p] - far[:, p:p + 1]), out=bound)
            least[:, ranged] = bound
        least[~vectors.any(axis=1)] = 0.0
        if own_only:
            near = np.full((len(vectors), len(names)), np.inf)
            if ranged.any():
                near[:, ranged] = far[:, names[ranged]]
            take = np.zeros(least.shape, bool)
            take[np.arange(len(vectors)), near.argmin(axis=1)] = True
        else:
            bars = rows["bar"].to_numpy()
            reach = np.where(np.isnan(bars), np.inf, np.sqrt(np.maximum(2.0 - 2.0 * np.nan_to_num(bars), 0.0) + SLACK) + SLACK)
            # A bar of zero or less is met by vectors of length zero and by all that lie across.
            take = least <= reach[:, None]
            if "seen" in rows.column_names:
                take &= rows["seen"].to_numpy()[:, None] != names[None, :]
        _, which = np.nonzero(take)
        bounds = np.concatenate(([0], np.cumsum(take.sum(axis=1)))).astype(np.int32)
        return rows.append_column("homes", pa.ListArray.from_arrays(pa.array(bounds), pa.array(names[which])))

    return _grouped(dealt, chunks.join(pivots, SCOPE).join(maps, SCOPE), run, schema)


def met(left: DataFrame, right: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visiting rows and homes dealt to block pairs (home, lb, rb), and the number of pairs of each home."""
    left = left.withColumn("home", F.explode("homes")).drop("homes")
    count = lambda df, name: df.groupBy(*SCOPE, "home").agg(F.count("*").alias(name))
    plan = cut_lineage(count(left, "nl").join(count(right, "nr"), [*SCOPE, "home"]), "visits")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block_rows)).cast("int")
    sized = plan.select(*SCOPE, "home", blocks("nl").alias("bl"), blocks("nr").alias("br"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    keys = [*SCOPE, "home"]
    l = left.join(sized, keys).withColumn("lb", mine("query_id", "bl")).withColumn("rb", every("br")).drop("bl", "br")
    r = right.join(sized, keys).withColumn("rb", mine("item_id", "br")).withColumn("lb", every("bl")).drop("bl", "br")
    return l, r, plan
