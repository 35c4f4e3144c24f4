"""Exact centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round builds the tree anew on the driver from the centroids (a parameter's number of them) and
broadcasts it. Every vector searches it best first: nodes wait with a lower bound of the distance to any
centroid below them, and a node is left out only if its bound exceeds the best distance so far; a bound
equal to it is still followed, so that ties are seen and the smaller number wins. Distances at the nodes are
exact integers; bounds are roots in floating point, moved outward by more than their error.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import cut_lineage

SCALE = 64
#: Components up to this size have squared distances (64 of them) and roots that 64-bit words hold.
SMALL = 1 << 27
LIMB = 30
_SLACK = 2.0 ** -48


@dataclass
class Node:
    """A centroid as vantage point; the near and the far child each with the range of root distances to it."""

    number: int
    near: tuple[int, int, int] | None = None
    far: tuple[int, int, int] | None = None


def build_tree(centroids: list[tuple[int, ...]]) -> list[Node]:
    """Nodes in the order in which they were split off; ranges are (child, floor of the least root, ceiling of the greatest)."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at, vantage = len(nodes), members[0]
        nodes.append(Node(vantage))
        others = sorted((sum((a - b) ** 2 for a, b in zip(centroids[vantage], centroids[m])), m) for m in members[1:])
        half = (len(others) + 1) // 2
        for side, part in (("near", others[:half]), ("far", others[half:])):
            if part:
                low, high = math.isqrt(part[0][0]), math.isqrt(part[-1][0])
                setattr(nodes[at], side, (grow([m for _, m in part]), low, high + 1))
        return at

    if centroids:
        grow(list(range(len(centroids))))
    return nodes


def nearest_one(nodes: list[Node], centroids: list[tuple[int, ...]], vector: tuple[int, ...]) -> tuple[int, int]:
    """(cluster, squared distance) of one vector of integers of any size, by best-first search."""
    best = None
    waiting = [(0, 0)]
    while waiting:
        bound, at = heapq.heappop(waiting)
        if best is not None and bound * bound > best[0]:
            break
        node = nodes[at]
        distance = sum((a - b) ** 2 for a, b in zip(vector, centroids[node.number]))
        best = min(best, (distance, node.number)) if best else (distance, node.number)
        root = math.isqrt(distance)
        for child in (node.near, node.far):
            if child:
                heapq.heappush(waiting, (max(bound, root - child[2], child[1] - root - 1, 0), child[0]))
    return best[1], best[0]


def nearest(nodes: list[Node], centroids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, squared distances) of many vectors of small integers: each follows its own best-first order, in step."""
    n = len(vectors)
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, len(nodes), dtype=np.int64)
    bounds = np.full((n, len(nodes)), np.inf)
    bounds[:, :1] = 0.0
    open_rows = np.arange(n)
    while len(open_rows):
        choice = bounds[open_rows].argmin(axis=1)
        bound = bounds[open_rows, choice]
        # Inclusive: a bound equal to the radius is still searched.
        go = bound <= np.sqrt(best[open_rows].astype(np.float64)) * (1 + _SLACK)
        go &= np.isfinite(bound)
        open_rows, choice, bound = open_rows[go], choice[go], bound[go]
        for at in np.unique(choice):
            mine = choice == at
            rows, node = open_rows[mine], nodes[at]
            gap = vectors[rows] - centroids[node.number]
            distance = np.einsum("ij,ij->i", gap, gap)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (node.number < cluster[rows]))
            best[rows[closer]], cluster[rows[closer]] = distance[closer], node.number
            bounds[rows, at] = np.inf
            root = np.sqrt(distance.astype(np.float64))
            for child in (node.near, node.far):
                if child:
                    to, low, high = child
                    least = np.maximum(root - high, low - root)
                    least -= (root + high) * _SLACK
                    bounds[rows, to] = np.maximum(least, bound[mine])
    return cluster, best


def _floor(x: float) -> int:
    """floor(64 * x) exactly; from 2^53 on every double is whole, and the product may leave its range."""
    return math.floor(x * SCALE) if abs(x) < 2.0 ** 53 else int(x) * SCALE


def quantised(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their doubles, which of them are small) of an array of lists."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = np.array([-1 if n is None else n for n in vectors.value_lengths().to_pylist()])
    right = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(right)).flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims) if len(right) else np.zeros((0, dims))
    # A null component reads as NaN here.
    finite = np.isfinite(values).all(axis=1)
    values = values[finite]
    return right[finite], values, (np.abs(values) < SMALL / SCALE).all(axis=1)


@dataclass
class Search:
    """What a round broadcasts: the centroids and their tree."""

    centroids: list[tuple[int, ...]]
    nodes: list[Node]

    @staticmethod
    def of(centroids: list[tuple[int, ...]]) -> Search:
        return Search(centroids, build_tree(centroids))

    def assign(self, values: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, list[tuple[int, ...]]]:
        """(clusters, distances, small vectors as integers, the others as tuples), distances in the order of the rows."""
        clusters, distances = np.zeros(len(values), np.int64), np.zeros(len(values), object)
        inside = all(abs(c) < SMALL for centroid in self.centroids for c in centroid)
        fast = small & inside
        whole = np.floor(values[fast] * SCALE).astype(np.int64)
        if len(whole):
            clusters[fast], distances[fast] = nearest(self.nodes, np.array(self.centroids, dtype=np.int64), whole)
        rest = [tuple(map(_floor, row)) for row in values[~fast].tolist()]
        for at, vector in zip(np.flatnonzero(~fast), rest):
            clusters[at], distances[at] = nearest_one(self.nodes, self.centroids, vector)
        return clusters, distances.tolist(), whole, rest


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in base 2^30, digits with its sign."""
    sign, rest, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while rest:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest, place = rest >> LIMB, place + 1


def _vectors(table: DataFrame) -> DataFrame:
    return table.select(F.col("embedding").alias("v"))


def _sums(vectors: DataFrame, search, dims: int) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Exact component sums and sizes of the clusters: summed per batch, then by Spark, digit by digit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values, small = quantised(batch.column(0), dims)
            clusters, _, whole, rest = search.value.assign(values, small)
            out: dict[tuple[int, int, int], int] = {}
            fast = np.ones(len(values), bool)
            if rest:
                fast = small if len(whole) else np.zeros(len(values), bool)
            slow = [(c, v) for c, v in zip(clusters[~fast].tolist(), rest)]
            for c in np.unique(clusters[fast]).tolist():
                chosen = whole[clusters[fast] == c]
                out[c, -1, 0] = len(chosen)
                slow.append((c, tuple(chosen.sum(axis=0).tolist())))
            for c in [c for c, _ in slow[:len(rest)]]:
                out[c, -1, 0] = out.get((c, -1, 0), 0) + 1
            for c, vector in slow:
                for i, x in enumerate(vector):
                    for place, digit in _limbs(x):
                        out[c, i, place] = out.get((c, i, place), 0) + digit
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[j] for k in keys], pa.int32()) for j in range(3)), pa.array([out[k] for k in keys], pa.int64())],
                ["cluster", "i", "place", "digit"])

    parts = vectors.mapInArrow(run, "cluster int, i int, place int, digit long")
    # At most clusters * components * digits of a double (35) rows, whatever the table holds.
    rows = parts.groupBy("cluster", "i", "place").agg(F.sum(F.col("digit").cast("decimal(20,0)")).alias("digit")).collect()
    sums: dict[int, list[int]] = {}
    sizes: dict[int, int] = {}
    for r in rows:
        if r["i"] < 0:
            sizes[r["cluster"]] = int(r["digit"])
        else:
            sums.setdefault(r["cluster"], [0] * dims)[r["i"]] += int(r["digit"]) << (LIMB * r["place"])
    return sums, sizes


def first_centroids(table: DataFrame, k: int, dims: int) -> list[tuple[int, ...]]:
    """The k kept vectors with the smallest sha256 of `1:<vec_id>`; equal hashes (repeated ids) by their components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, _ = quantised(batch.column(1), dims)
            names = ["null" if i is None else str(i) for i in batch.column(0).take(pa.array(at)).to_pylist()]
            hashes = np.array([hashlib.sha256(f"1:{n}".encode()).hexdigest() for n in names], dtype=object)
            keep = np.argsort(hashes, kind="stable")
            # Only rows up to the k-th hash of the batch can be among the first.
            if len(keep) > k:
                keep = np.flatnonzero(hashes <= hashes[keep[k - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].tolist(), pa.string()),
                                              pa.array(list(values[keep]), pa.list_(pa.float64()))], ["hash", "v"])

    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, "hash string, v array<double>")
    return [tuple(map(_floor, r["v"])) for r in rows.orderBy("hash", "v").limit(k).collect()]


def cluster_vectors(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> DataFrame:
    """Per kept vector vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, not of `dims` components, or hold null or non-finite ones are left out; repeated
    rows and null ids are answered each. Fewer vectors than k make fewer centroids; none make an empty
    result. Components of any finite size are assigned exactly; a distance or inertia beyond the range of long is
    null. Other columns are ignored. Only k centroids and their digit sums reach the driver.
    """
    spark = table.sparkSession
    centroids = first_centroids(table, k, dims)
    for _ in range(rounds):
        sums, sizes = _sums(_vectors(table), spark.sparkContext.broadcast(Search.of(centroids)), dims)
        centroids = [tuple(s // sizes[c] for s in sums.get(c, [0] * dims)) if c in sizes else old for c, old in enumerate(centroids)]
    search = spark.sparkContext.broadcast(Search.of(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, small = quantised(batch.column(1), dims)
            clusters, distances, _, _ = search.value.assign(values, small)
            distances = [d if d < 1 << 63 else None for d in map(int, distances)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(clusters, pa.int32()), pa.array(distances, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    assigned = cut_lineage(table.select("vec_id", F.col("embedding").alias("v")).mapInArrow(
        run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    # A sum over a missing distance is beyond long itself. At most k rows reach the driver.
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: None if r["t"] is None else int(r["t"]) for r in assigned.groupBy("cluster").agg(total.alias("t")).collect()}
    inertia = None if None in sums.values() else sum(sums.values())
    fits = lambda x: None if x is None or x >= 1 << 63 else x
    sha = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    named = spark.createDataFrame([(c, fits(s), fits(inertia), sha(centroids[c])) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
