"""Near-duplicate vectors by sorted projection passes.

Each pass draws its own random hyperplanes, concatenates the signs into a code and orders the vectors of a
label by it. Vectors that lie close agree in most signs, so in some pass they stand close together. Every
vector is compared with its next neighbours; where a window's last tile still found a link the window
goes on, so a large group of near copies is compared whole and no count of partners is capped. Verified
pairs of all passes are united.

Tiles are cut by a vector's place in the whole order of its label and pass, never by partition: a block of
BLOCK vectors is compared with itself and the first tile of the next block, and a tile whose window has not
ended there goes on against one further block a round. So pairs and components do not depend on how many
partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memloom.llm.components import components
from memloom.session import cut_lineage

PASSES = 12
CODE_BITS = 48
TILE = 64
#: Vectors that one task holds of an order at a time; whole tiles.
BLOCK = 8 * TILE
#: What an order of vectors belongs to.
ORDER = ["pass", "width", "label"]


def _usable(v: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component to about one: exact, and no square leaves its range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def codes(vectors: np.ndarray, number: int) -> np.ndarray:
    """The sign code of each vector in one pass; planes depend on the pass and the dimension alone."""
    planes = np.random.default_rng([number, vectors.shape[1]]).normal(size=(vectors.shape[1], CODE_BITS))
    return ((vectors @ planes) > 0) @ (np.int64(1) << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))


def grown_links(vectors: np.ndarray, starts: list[tuple[int, int, int]], least: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (i, j), i < j, with cosine of at least `least`, and the windows that reach the end still finding links.

    starts: each window's rows [low, high) and where it goes on; one that starts at its own rows sees the next tile too.
    """
    norms, n = np.sqrt((vectors * vectors).sum(1)), len(vectors)
    left, right, still = [], [], []
    for number, (low, high, at) in enumerate(starts):
        rows = slice(low, high)
        while at < n:
            # The first step sees the tile itself and the next one, each further step one more tile.
            end = min(at + (2 * TILE if at == low else TILE), n)
            cosine = (vectors[rows] @ vectors[at:end].T) / (norms[rows, None] * norms[None, at:end])
            i, j = np.nonzero(cosine >= least)
            i, j = i + low, j + at
            ahead = j > i
            left.append(i[ahead])
            right.append(j[ahead])
            if not (j[ahead] >= end - TILE).any():
                break
            at = end
        else:
            still.append(number)
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)]), still


def window_links(vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of ordered vectors with cosine of at least `least`, window by window."""
    n = len(vectors)
    return grown_links(vectors, [(low, min(low + TILE, n), low) for low in range(0, n, TILE)], least)[:2]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that the pairs connect each of n indices with."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _placed(classes: DataFrame, passes: int) -> DataFrame:
    """number, pass, width, label, place, size: where each class stands in each pass, of how many in its order."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            for width in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == width))
                x = scaled(rows.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
                for number in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), number, np.int32)), pa.array(np.full(len(x), width, np.int32)), pa.array(codes(x, number)), *rows.columns[:3]],
                        ["pass", "width", "code", *rows.schema.names[:3]])

    projected = classes.select("id", "number", "label", "embedding").mapInArrow(
        project, f"pass int, width int, code long, id long, number long, label {classes.schema['label'].dataType.simpleString()}")
    order = ["pass", "width", "label", "code", "id", "number"]
    # The row number of Spark has the partition above bit 33. Written once, it stays.
    ranged = cut_lineage(projected.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *ORDER, "number", F.monotonically_increasing_id().alias("_row")), "vector-order").withColumn("_part", F.shiftright("_row", 33))
    counted = ranged.groupBy(*ORDER, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*ORDER)  # one row a partition
    counted = counted.withColumns({
        "_before": F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), "size": F.sum("_n").over(whole)})
    return cut_lineage(ranged.join(counted.drop("_n"), [*ORDER, "_part"]).select(
        *ORDER, "number", (F.col("_row") - F.col("_first") + F.coalesce("_before", F.lit(0))).alias("place"), "size"), "vector-places")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows alike in the keys, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(k) for k in keys]
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        for low, high in zip([0, *(np.flatnonzero(change) + 1)], [*(np.flatnonzero(change) + 1), n]):
            if held and any(held[0].column(k)[0] != c[int(low)] for k, c in zip(keys, columns)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _compared(rows: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Rows (star, a, b, n_a, n_b) of links, and (pass, width, label, tile, next, size) of windows that have to go on.

    rows: pass, width, label, block, number, place, size, and since: null in a row that is only looked at,
    else the place at which the window of the row's tile goes on.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, [*ORDER, "block"]):
            ids, n, place = (table[c].to_numpy() for c in ("id", "n", "place"))
            since = table["since"].fill_null(-1).to_numpy()
            size, count = table["size"][0].as_py(), len(ids)
            x = scaled(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(count, -1))
            lows = np.flatnonzero((since >= 0) & (place % TILE == 0))
            starts = [(int(i), min(int(i) + TILE, count), int(np.searchsorted(place, since[i]))) for i in lows]
            i, j, still = grown_links(x, starts, least)
            root = _roots(count, i, j)
            star = np.flatnonzero(root != np.arange(count))
            for flag, p, q in ((False, i, j), (True, star, root[star])):
                if len(p):
                    swap = ids[p] > ids[q]
                    a, b = np.where(swap, q, p), np.where(swap, p, q)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), flag)), pa.array(ids[a]), pa.array(ids[b]), pa.array(n[a]), pa.array(n[b]),
                         *[pa.nulls(len(a), links.field(c).type) for c in links.names[5:]]], schema=links)
            at = int(place[-1]) + 1
            if still and at < size:
                m = len(still)
                same = [pa.array([table[c][0].as_py()] * m, links.field(c).type) for c in ORDER]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(m, links.field(c).type) for c in links.names[:5]], *same,
                     pa.array([int(place[lows[s]]) // TILE for s in still]), pa.array([at] * m), pa.array([size] * m)], schema=links)

    label = classes.schema["label"].dataType
    links = pa.schema([("star", pa.bool_()), *[(c, pa.int64()) for c in ("a", "b", "n_a", "n_b")], ("pass", pa.int32()), ("width", pa.int32()),
                       ("label", to_arrow_type(label)), *[(c, pa.int64()) for c in ("tile", "next", "size")]])
    keys = [*ORDER, "block"]
    whole = rows.join(classes.select("number", "id", "n", "embedding"), "number").repartition(*keys).sortWithinPartitions(*keys, "place")
    return whole.select(*keys, "place", "since", "size", "id", "n", "embedding").mapInArrow(
        compare, f"star boolean, a long, b long, n_a long, n_b long, pass int, width int, label {label.simpleString()}, tile long, next long, size long")


def linked_pairs(classes: DataFrame, least: float, passes: int) -> DataFrame:
    """Rows (star, a, b, n_a, n_b): verified pairs of each pass, and stars that connect what they connect.

    classes: number (unique), id, n, label, embedding; equal vectors are one row already.
    """
    placed = _placed(classes, passes)
    block = F.floor(F.col("place") / BLOCK)
    tile = F.floor(F.col("place") / TILE)
    # Each block, and the first tile of the next one.
    own = placed.select("*", block.alias("block"), (tile * TILE).alias("since"))
    ahead = placed.where((F.col("place") % BLOCK < TILE) & (F.col("place") >= BLOCK)).select("*", (block - 1).alias("block"), F.lit(None).cast("long").alias("since"))
    found = cut_lineage(_compared(own.unionByName(ahead), classes, least), "vector-links")
    links = found.where("star IS NOT NULL")
    while not (going := found.where("star IS NULL").select(*ORDER, "tile", "next")).isEmpty():
        # A task has the tiles of one block that go on, and what is left of the block in which they do.
        going = going.withColumns({"block": F.floor(F.col("tile") * TILE / BLOCK), "to": F.floor(F.col("next") / BLOCK)})
        tiles = placed.withColumn("tile", tile).join(going.select(*ORDER, "tile", "block", F.col("next").alias("since")), [*ORDER, "tile"]).drop("tile")
        seen = placed.withColumn("to", block).join(going.select(*ORDER, "to", "block", "next").distinct(), [*ORDER, "to"]).where(
            F.col("place") >= F.col("next")).drop("to", "next").withColumn("since", F.lit(None).cast("long"))
        found = cut_lineage(_compared(tiles.unionByName(seen), classes, least), "vector-links")
        links = links.unionByName(found.where("star IS NOT NULL"))
    return links.select("star", "a", "b", "n_a", "n_b")


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept of each row of vec_id, label, embedding.

    Rows link only within a label. Null labels and vectors that are null, zero, or hold null or non-finite
    values link with nothing, nor do vectors of different lengths. Equal vectors are compared once and
    counted as often as they stand, so a repeated row is one more vector. Rows that repeat a vec_id with
    other vectors share its component.
    """
    v = F.col("embedding")
    rows = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull() & _usable(v), v).alias("embedding")).withColumns(
        {"h1": F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding")), "h2": F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(2), "embedding"))})
    same = ["label", "h1", "h2"]
    classes = rows.where(F.col("h1").isNotNull()).groupBy(*same).agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = cut_lineage(classes.where(F.col("id").isNotNull()).withColumn("number", F.monotonically_increasing_id()), "vector-classes")
    found = cut_lineage(linked_pairs(classes, least, passes), "vector-links")
    pairs = found.where("NOT star").groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    links = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("id"), F.col("n_a").alias("n")))).alias("l")).groupBy(
        F.col("l.id").alias("id")).agg(F.sum("l.n").alias("others"))
    known = components(found.where("star").select("a", "b"), "vector-components")
    told = classes.drop("embedding", "number").join(links, "id", "left").join(known.withColumnRenamed("node", "id"), "id", "left").select(
        *same, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.select("vec_id", *same).join(told, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
