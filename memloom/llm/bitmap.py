"""Pre-filters for joins of texts with a set of ids.

A bitmap of hashed ids is built by a combined aggregate and broadcast; it is at most 2^MOST_BITS bits
whatever the set. Rows whose bit is clear are certainly not in the set, so they need no shuffle. When the
set outgrows the bitmap the join still gives the same rows and only shuffles more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 24


def _hash(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(91), column), F.lit(1 << bits))


def marked(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`df` with boolean _maybe: false only if the column's value is not among the one column of `ids`."""
    name = ids.columns[0]
    bits = min(MOST_BITS, max(12, (ids.count() * 16).bit_length()))
    table = ids.select(_hash(name, bits).alias("h")).groupBy(F.shiftright("h", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("_set"))
    # At most 2^(MOST_BITS - 6) rows of two longs.
    joined = df.withColumn("_h", _hash(column, bits)).withColumn("_word", F.shiftright("_h", 6)).join(F.broadcast(table), "_word", "left")
    bit = F.expr("shiftrightunsigned(_set, cast(_h % 64 as int)) & 1L") == 1
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_h", "_word", "_set")


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows that may be among the ids (all that are, and few others)."""
    return marked(df, column, ids).where("_maybe").drop("_maybe")


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows that are not among the ids; null stays. Only rows that the bitmap cannot clear are shuffled."""
    name = ids.columns[0]
    rows = marked(df, column, ids)
    doubtful = rows.where("_maybe").join(ids.select(F.col(name).alias("_id")), F.col(column) == F.col("_id"), "left_anti")
    return rows.where("NOT _maybe").unionByName(doubtful).drop("_maybe")
