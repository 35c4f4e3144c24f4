"""Which pairs of a large scope can reach a threshold: short sketches that bound every cosine from above.

A sketch holds a vector's first coordinates in an orthonormal basis and the lengths of what is left over, so by
Cauchy and Schwarz the cosine of two vectors is at most the product of their coordinates plus that of the lengths.
The basis is fitted to a sample and decides only how few pairs are left: the bound holds for every basis. Sketches are a
fraction of the vectors, so scopes are cut into fewer, larger blocks and vectors are not copied to each of them;
only pairs whose bound reaches the threshold fetch their vectors. Rows that are close to very many others (groups of
near copies) are named instead of paired, and meet each other with all of their vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.pivots import unit_rows

#: Coordinates of a sketch, those of the first look, and rows that a basis is fitted to.
COORDINATES, FIRST, SAMPLE = 96, 48, 2048
#: Candidates of a row in one block before it is named crowded.
CROWDED = 32
#: Room for coordinates of half precision (2^-11 of each vector) and products of single precision.
SLACK = 2e-3
_TILE_ROWS, _TILE_COLS, _PAIRS = 512, 1024, 1 << 14


def fit_basis(vectors: DataFrame, n: int) -> np.ndarray:
    """Orthonormal directions (dimensions, coordinates) by the weight that about SAMPLE of n vectors give them."""
    share = F.pmod(F.xxhash64(F.lit("basis"), "item_id"), F.lit(max(1, n // SAMPLE))) == 0
    rows = vectors.where(share).select("vector").limit(2 * SAMPLE).toArrow()["vector"]
    sample = unit_rows(rows)
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not sample.any():
        return np.eye(sample.shape[1])[:, :COORDINATES]
    # With a row for each dimension the directions span all of it, however few rows the sample has.
    return np.linalg.svd(np.concatenate([sample, np.eye(sample.shape[1]) * 1e-6]), full_matrices=False)[2][:COORDINATES].T


def _lengths(squares: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares - np.einsum("ij,ij->i", coordinates, coordinates), 0.0))


def sketch(basis: np.ndarray):
    """Vector to bytes: coordinates of half precision, then the lengths left over after FIRST and after all of them."""

    @F.arrow_udf("binary")
    def run(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.binary())
        unit = unit_rows(pa.chunked_array([vectors]))
        at, squares = unit @ basis, np.einsum("ij,ij->i", unit, unit)
        left = np.stack([_lengths(squares, at[:, :FIRST]), _lengths(squares, at)], axis=1).astype(np.float32)
        raw = np.concatenate([at.astype(np.float16).view(np.uint8), left.view(np.uint8)], axis=1)
        return pa.array([r.tobytes() for r in raw], pa.binary())

    return run


def _read(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows for the first look, rows for the second): coordinates and the length left over."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    left = np.ascontiguousarray(raw[:, -8:]).view(np.float32)
    at = np.ascontiguousarray(raw[:, :-8]).view(np.float16).astype(np.float32)
    return np.concatenate([at[:, :FIRST], left[:, :1]], axis=1), np.concatenate([at, left[:, 1:]], axis=1)


def _reaching(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs whose bound is at least `least`."""
    r, c = np.divmod(np.flatnonzero(x[0] @ y[0].T >= least), len(y[0]))
    if len(r) > _PAIRS:
        return np.divmod(np.flatnonzero(x[1] @ y[1].T >= least), len(y[1]))
    keep = np.einsum("ij,ij->i", x[1][r], y[1][c]) >= least
    return r[keep], c[keep]


def _candidates(threshold: float, earlier_only: bool, crowded: int):
    schema = pa.schema([("query_id", pa.string()), ("item_id", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        left = left.rename_columns([c.removeprefix("l_") for c in left.column_names])
        if earlier_only:
            # In order of time, whole tiles hold nothing earlier.
            left, right = left.sort_by("last_seq"), right.sort_by("first_seq")
        x, y, least = _read(left["sketch"]), _read(right["sketch"]), np.float32(threshold - SLACK)
        ids, names = (np.asarray(t.to_pylist(), dtype=object) for t in (left["query_id"], right["item_id"]))
        if earlier_only:
            after, open_from = left["last_seq"].to_numpy(), left["open_seq"].to_numpy()
            born, dead = right["first_seq"].to_numpy(), right["dead_seq"].to_numpy()
        close, met = np.zeros(len(ids), np.int64), np.zeros(len(names), bool)
        rows, cols = [], []
        for top in range(0, len(ids), _TILE_ROWS):
            a = tuple(m[top:top + _TILE_ROWS] for m in x)
            for start in range(0, len(names), _TILE_COLS):
                if earlier_only and born[start] >= after[top:top + _TILE_ROWS][-1]:
                    break
                r, c = _reaching(a, tuple(m[start:start + _TILE_COLS] for m in y), least)
                r, c = r + top, c + start
                if earlier_only:
                    keep = (born[c] < after[r]) & (dead[c] >= open_from[r]) & (names[c] != ids[r])
                    r, c = r[keep], c[keep]
                close += np.bincount(r, minlength=len(close))
                # A crowded row keeps no pairs, so what a task holds is bounded by its rows.
                many = close[r] > crowded
                met[c[many]] = True
                rows.append(r[~many].astype(np.int32))
                cols.append(c[~many].astype(np.int32))
        r, c = (np.concatenate([np.zeros(0, np.int32), *parts]) for parts in (rows, cols))
        many = close[r] > crowded
        met[c[many]] = True
        lone, seen = ids[close > crowded], names[met]
        return pa.table({
            "query_id": pa.array([*ids[r[~many]], *lone, *[None] * len(seen)], pa.string()),
            "item_id": pa.array([*names[c[~many]], *[None] * len(lone), *seen], pa.string()),
        }, schema=schema)

    return run


def candidates(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, earlier_only: bool, crowded: int | None = None) -> DataFrame:
    """(query_id, item_id) of all pairs of one block that can reach the threshold, by left and right rows with a sketch.

    A left row with more of them in a block than `crowded` is a row without item_id instead, and each right row that it can
    reach there a row without query_id.
    """
    mine = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    return mine.groupBy(*[f"l_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInArrow(
        _candidates(threshold, earlier_only, CROWDED if crowded is None else crowded), "query_id string, item_id string")


def exact_score(digits: int):
    """Cosine of two vectors in double precision, rounded."""

    @F.arrow_udf("double")
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        pairs = (unit_rows(pa.chunked_array([v])) for v in (x, y))
        return pa.array(np.round(np.einsum("ij,ij->i", *pairs), digits))

    return score
