"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `nodes` points of a ring; a row belongs to the arc before the first point clockwise
of its hash. A shard takes no more rows than its quota (the quotas differ by one at most and add up to
all rows), and what overflows goes on clockwise to the next shard with room. The walk sees only the
counts of the arcs, a table of fixed size; rows learn their shard from their rank inside the arc.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import cut_lineage

ARC_BITS = 14
LAW = "rows"


def ring_points(shards: int, nodes: int, bits: int = ARC_BITS) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes in ring order; the first taker keeps a position."""
    taken: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            taken.setdefault(xxhash.xxh64_intdigest(f"{shard}/{node}") >> (64 - bits), shard)
    return sorted(taken.items())


def walk(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) from the rows of each arc.

    Round after round, what is left of an arc asks the next shard clockwise; arcs ask in ring order.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, waiting, step, out = [0] * shards, {a: 0 for a in sorted(counts) if counts[a]}, 0, []
    while waiting:
        for arc in list(waiting):
            shard, done = points[(arc + step) % len(points)][1], waiting[arc]
            n = min(counts[arc] - done, room[shard] - used[shard])
            if n > 0:
                out.append((arc, done, done + n, shard, used[shard]))
                used[shard] += n
                waiting[arc] += n
                if waiting[arc] == counts[arc]:
                    del waiting[arc]
        step += 1
    return out


def _table(spark, rows, schema: str) -> DataFrame:
    """A table of plan constants, built by the JVM and written once."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = ", ".join(c.replace(" ", ":") for c in schema.split(", "))
    return cut_lineage(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>"))), "ring-plan")


def bounded_ring(df: DataFrame, key: list[str], shards: int, nodes: int = 64) -> DataFrame:
    """`key` columns of all rows with shard and slot (gapless from 0 in each shard).

    Law `rows`: shard counts differ by one at most. Rows that are alike in all key columns are counted
    before the shuffle, so a repeated row is no hot key. Ranks run by hash, then key; nulls are keys
    like any other. An empty table gives an empty result. About 1 / (2 * nodes) ** 0.5 of the rows move
    off their arc's own shard.
    """
    spark = df.sparkSession
    points = ring_points(shards, nodes)
    starts = [p for p, _ in points]
    # A position belongs to the first point at or after it; behind the last point it wraps to point 0.
    arcs, at = [], 0
    for p in range(1 << ARC_BITS):
        while at < len(starts) and starts[at] < p:
            at += 1
        arcs.append(at % len(points))
    position = F.shiftrightunsigned(F.col("_hash"), 64 - ARC_BITS)
    grouped = df.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64(*key)).withColumn("_at", position)
    grouped = cut_lineage(grouped, "ring")
    # Only as many positions as the ring has (2^14), whatever the data.
    by_position = {r["_at"]: r["n"] for r in grouped.groupBy("_at").agg(F.sum("_n").alias("n")).collect()}
    by_arc: dict[int, int] = {}
    base = {}
    for p in sorted(by_position, key=lambda p: (arcs[p], p <= starts[-1], p)):
        base[p] = by_arc.get(arcs[p], 0)
        by_arc[arcs[p]] = base[p] + by_position[p]
    spans = walk(by_arc, points, shards)
    of_arc: dict[int, list] = {}
    for span in spans:
        of_arc.setdefault(span[0], []).append(span[1:])
    # One row for each position and each span of its arc that it reaches into.
    rows = [(p, base[p], low, high, shard, slot) for p in by_position for low, high, shard, slot in of_arc[arcs[p]]
            if low < base[p] + by_position[p] and high > base[p]]
    plan = _table(spark, rows, "_at bigint, _base bigint, _low bigint, _high bigint, shard int, _slot bigint")
    before = Window.partitionBy("_at").orderBy("_hash", *[F.col(k).asc_nulls_first() for k in key])
    ranked = grouped.withColumn("_first", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    # The plan has at most 2^14 rows and a few per span: a proven bound, so it is broadcast.
    placed = ranked.join(F.broadcast(plan), "_at").where(
        (F.col("_base") + F.col("_first") < F.col("_high")) & (F.col("_base") + F.col("_first") + F.col("_n") > F.col("_low")))
    low = F.greatest(F.col("_low"), F.col("_base") + F.col("_first"))
    high = F.least(F.col("_high"), F.col("_base") + F.col("_first") + F.col("_n")) - 1
    return placed.select(*key, "shard", F.explode(F.sequence(low - F.col("_low") + F.col("_slot"), high - F.col("_low") + F.col("_slot"))).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, nodes: int = 64) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, 16 more), text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes and the checksum of the empty text; null ids are placed by size and checksum.
    grown_shard is null: under law `rows` other rows decide too. Further columns are ignored.
    """
    sized = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    placed = bounded_ring(sized, ["doc_id", "size", "text_crc32"], shards, nodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
