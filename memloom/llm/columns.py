"""Keep whatever other columns a table has out of the way of an operator's own names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, used: list[str]) -> tuple[DataFrame, list[str]]:
    """`df` with every column that is not in `used` renamed by its place, and the names to give back with toDF."""
    return df.toDF(*[c if c in used else f"x{i}" for i, c in enumerate(df.columns)]), df.columns
