"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(
        F.slice(_doubles(a), F.lit(1), n), F.slice(_doubles(b), F.lit(1), n), lambda x, y: x * y
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; zero when either vector is zero there."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    scale = norm(left) * norm(right)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(left, right) / scale)


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / length))


def parse_embedding(text: Column) -> Column:
    """A bracketed list to an array; null when it is not one or is empty."""
    values = F.from_json(text, "array<double>")
    return F.when(F.size(values) > 0, values)


def checked_dims(v: Column, dims: int) -> Column:
    """The vector itself; a vector of another length fails the job."""
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(
        F.raise_error(F.format_string("expected %d dimensions, got %d", F.lit(dims), F.size(v)))
    )


def distance_to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance
