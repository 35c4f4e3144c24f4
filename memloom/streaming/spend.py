"""Running spend per conversation, as a batch plan and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.operators.conversations import COST_CEILING_USD
from memloom.session import keep_state_in_rocksdb

WATERMARK = "10 minutes"
#: Entries of the state that hold a batch's waiting turns at most, and turns that one entry holds before there are more.
BUCKETS, ENTRY_TURNS = 64, 64
#: Costs add up as whole parts of a dollar, so that sums do not depend on their order.
UNITS = 10**12
ALERT = "conversation_id string, ts timestamp, seq bigint, running double"


def cost_units(cost: Column) -> Column:
    return F.coalesce(F.round(cost.cast("double") * float(UNITS)).cast("long"), F.lit(0).cast("long"))


def _whole(dollars: float) -> int:
    return round(dollars * UNITS)


def spend_alerts(usage: DataFrame, ceiling: float = COST_CEILING_USD) -> DataFrame:
    """The turn at which each conversation reached its ceiling: one alert per conversation.

    Daily totals decide the day first, so only that day's turns of a long conversation are ordered.
    """
    timed = usage.withColumns({"cost": cost_units(F.col("cost_usd")), "day": F.to_date("ts")})
    most = _whole(ceiling)
    days = timed.groupBy("conversation_id", "day").agg(F.sum("cost").alias("day_cost"))
    by_day = Window.partitionBy("conversation_id").orderBy("day")
    crossed = days.withColumn("total", F.sum("day_cost").over(by_day)).withColumn(
        "before", F.col("total") - F.col("day_cost")
    )
    near = crossed.where((F.col("total") >= most) & (F.col("before") < most))
    turns = timed.join(near.select("conversation_id", "day", "before"), ["conversation_id", "day"])
    order = Window.partitionBy("conversation_id", "day").orderBy("ts", "seq")
    running = turns.withColumn("running", F.col("before") + F.sum("cost").over(order))
    reached = running.where(F.col("running") >= most)
    return reached.groupBy("conversation_id").agg(F.min(F.struct("ts", "seq", "running")).alias("a")).select(
        "conversation_id", "a.ts", "a.seq", (F.col("a.running") / UNITS).alias("running")
    )


def least_seq_from(alerts: DataFrame, usage: DataFrame) -> DataFrame:
    """(conversation_id, alert_seq, running): the least seq of the alert's turn and those after it in time.

    Costs are not negative, so these are the turns at which the running sum is at the ceiling or above it.
    """
    told = alerts.select("conversation_id", F.col("ts").cast("timestamp").alias("_ts"), F.col("seq").cast("long").alias("_seq"), "running")
    after = usage.select("conversation_id", "ts", "seq").join(told, "conversation_id").where(
        F.struct(F.col("ts").cast("timestamp").alias("_ts"), F.col("seq").cast("long").alias("_seq")) >= F.struct("_ts", "_seq"))
    return after.groupBy("conversation_id").agg(F.min("seq").alias("alert_seq"), F.min("running").alias("running"))


class CeilingWatch(StatefulProcessor):
    """One conversation: turns that the watermark has not passed yet, what was spent before them, and whether it was told.

    Turns count in order of time once the watermark has passed them, so the alert names the same turn however
    they arrive. A turn that comes again while it waits replaces itself; later it is older than the
    watermark and Spark leaves it out. After the alert nothing but the mark of it is kept. The turns of a batch wait
    in a few entries and one timer stands for the earliest of all, so calls to the state grow with the batches, not with the turns.
    """

    def __init__(self, ceiling: float) -> None:
        self.ceiling = _whole(ceiling)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint", "seq array<bigint>, at array<bigint>, cost array<bigint>")
        self.spent = handle.getValueState("spent", "spent bigint, told boolean, timer bigint, chunks bigint")

    def _state(self) -> tuple[int, bool, int, int]:
        return tuple(self.spent.get()) if self.spent.exists() else (0, False, 0, 0)

    def _wake(self, at: int) -> int:
        # Behind the turn's own millisecond: the watermark is then past the whole of it.
        self.handle.registerTimer(at // 1000 + 1)
        return at // 1000 + 1

    def _keep(self, chunks: int, seq: list[int], at: list[int], cost: list[int]) -> int:
        """Add turns as entries behind the first `chunks`; the number of entries after it."""
        wide = max(ENTRY_TURNS, -(-len(seq) // BUCKETS))
        for i in range(0, len(seq), wide):
            self.waiting.updateValue((chunks,), tuple(x[i:i + wide] for x in (seq, at, cost)))
            chunks += 1
        return chunks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, told, timer, chunks = self._state()
        if told:
            return iter([])
        seq, at, cost = ([x for part in parts for x in part] for parts in zip(*[[r[c].tolist() for c in ("seq", "at", "cost")] for r in rows]))
        chunks = self._keep(chunks, seq, at, [_whole(x) for x in cost])
        first = min(at)
        if not timer or first // 1000 + 1 < timer:
            timer = self._wake(first)
        self.spent.update((spent, False, timer, chunks))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spent, told, _, chunks = self._state()
        if told:
            return
        # All that the watermark has passed is final, not only what this timer stood for.
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        held: dict[int, tuple[int, int]] = {}
        for i in range(chunks):
            for seq, at, cost in zip(*self.waiting.getValue((i,))):
                # The first that came stands for those that came again.
                held.setdefault(seq, (at, cost))
        for at, seq, cost in sorted((at, seq, cost) for seq, (at, cost) in held.items() if at < upto):
            spent += cost
            if spent >= self.ceiling:
                self.waiting.clear()
                self.spent.update((spent, True, 0, 0))
                yield pd.DataFrame({"conversation_id": [key[0]], "ts": [pd.Timestamp(at, unit="us", tz="UTC")], "seq": [seq], "running": [spent / UNITS]})
                return
        self.waiting.clear()
        later = [(seq, at, cost) for seq, (at, cost) in held.items() if at >= upto]
        chunks = self._keep(0, *map(list, zip(*later))) if later else 0
        self.spent.update((spent, False, self._wake(min(at for _, at, _ in later)) if later else 0, chunks))

    def close(self) -> None:
        pass


def stream_spend_alerts(usage: DataFrame, ceiling: float = COST_CEILING_USD, delay: str = WATERMARK) -> DataFrame:
    """One alert per conversation of a stream usage(conversation_id, seq, ts, cost_usd): the turn that reaches the ceiling.

    The alert follows once the watermark has passed that turn. Turns older than the watermark are left out.
    """
    keep_state_in_rocksdb(usage.sparkSession)
    turns = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        "conversation_id", F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("at"),
        F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0)).alias("cost"))
    return turns.groupBy("conversation_id").transformWithStateInPandas(CeilingWatch(ceiling), ALERT, "Append", "EventTime")


def stream_spend(usage: DataFrame) -> DataFrame:
    """Update-mode running spend of a usage stream."""
    return usage.groupBy("conversation_id").agg(
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.count("*").alias("turns")
    )


def usage_sessions(usage: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of turns separated by a gap; works on tables and on watermarked streams."""
    timed = usage.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.groupBy("conversation_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return grouped.select("conversation_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                          "turns", "input_tokens", "output_tokens")
