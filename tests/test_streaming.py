"""The streams must say what the batch plans say."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.catalog import views
from memloom.operators import events
from memloom.plans.writeback import sentence_extractor
from memloom.session import scratch_path
from memloom.sources import tables
from memloom.operators import conversations as conv
from memloom.streaming import spend
from memloom.streaming.translate import add_numbers, read_events, read_late, translate_stream, write_events
from memloom.streaming.writeback import current, drain_stats, stream_writeback

KEEP = ["conversation_id", "turn", "seq", "idx", "type", "text", "tool_id", "name", "ok", "summary", "code", "message",
        "retryable", "session_id", "input_tokens", "output_tokens", "stop_reason"]


def test_translate_stream_equals_batch(spark, sf_dir):
    lines = views.stream_lines(spark, sf_dir).withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))).where(F.col("line").isNotNull())
    path = scratch_path(spark, "lines")
    records = lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))
    # Two files, one of them written twice: repeats must not be translated again.
    records.coalesce(1).write.text(path)
    records.limit(50).coalesce(1).write.mode("append").text(path)
    stream = translate_stream(tables.read_event_lines(spark, path, streaming=True))
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = sorted(map(str, spark.read.parquet(out).select(*KEEP).collect()))
    want = sorted(map(str, events.translate_lines(lines.drop("ts")).select(*KEEP).collect()))
    assert len(want) > 300
    assert got == want


def test_writeback_stream(spark):
    def poisoned(transcript):
        if "poison" in transcript:
            return "no json at all"
        facts = json.loads(sentence_extractor(transcript))["facts"]
        for fact in facts:
            fact["entities"] = [{"name": n, "kind": "concept"} for n in ("tea", "Parquet") if n in fact["content"]]
        return json.dumps({"facts": facts})

    now = F.lit(datetime(2024, 5, 1)).cast("timestamp")
    rows = [("c1", 0, "user", "I prefer tea over coffee in the morning. We chose Parquet because it is columnar.", "t", "u", "p"),
            ("c1", 1, "assistant", "Noted.", "t", "u", "p"),
            ("c2", 0, "user", "I prefer tea over coffee in the morning.", "t", "u", "p"),
            ("c3", 0, "user", "This one is poison for the extractor.", "t", "u", "p")]
    messages = spark.createDataFrame(rows, "conversation_id string, turn long, role string, text string, tenant string, user_id string, project string")
    root, jobs = scratch_path(spark, "root"), scratch_path(spark, "jobs")
    tables.enqueue_transcripts(tables.transcript_payload(messages), now).coalesce(1).write.mode("append").parquet(jobs)
    mark, seen = scratch_path(spark, "mark"), []
    for _ in range(3):
        query = stream_writeback(spark, jobs, root, mark, poisoned, now)
        query.awaitTermination(240)
        seen += [p["observedMetrics"]["queue"] for p in query.recentProgress if "queue" in p["observedMetrics"]]
    items = current(spark, root).collect()
    named = {r["name_norm"] for r in current(spark, root, "entities").collect()}
    assert named == {"parquet", "tea"} and current(spark, root, "links").count() == 2
    assert sorted(i["type"] for i in items) == ["decision", "preference"]
    assert {i["source"] for i in items if i["type"] == "decision"} == {"conversation:c1"}
    done = {r["conversation_id"]: (r["status"], r["attempts"]) for r in spark.read.parquet(f"{root}/jobs").collect()}
    assert done == {"c1": ("done", 1), "c2": ("done", 1), "c3": ("failed", 3)}
    outcomes = sorted(r["outcome"] for r in spark.read.parquet(f"{root}/outcomes").collect())
    assert outcomes == ["duplicate", "inserted", "inserted"]
    # What the stream observed is what the stored rows say: three jobs, one of them tried three times.
    assert sum(m["pending"] for m in seen) == 5
    told = spark.read.parquet(f"{root}/outcomes").select("job_id", "outcome")
    batch = conv.worker_stats(told).first()
    stats = drain_stats(spark, root).agg(*[F.sum(c).alias(c) for c in ("processed", "stored", "duplicates", "rejected", "failed")]).first()
    assert (stats["processed"], stats["failed"]) == (5, 3)
    assert [stats[c] for c in ("stored", "duplicates", "rejected")] == [batch[c] for c in ("stored", "duplicates", "rejected")]


def drive(stream, path, mark, mode="append"):
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination(240)


def test_spend_alerts_once_and_in_order_of_time(spark, sf_dir):
    schema = "conversation_id string, seq long, ts timestamp, cost_usd double"
    start = datetime(2024, 1, 1)
    at = lambda minute: start + timedelta(minutes=minute)
    rows = [("a", 1, at(0), 0.4), ("a", 2, at(1), 0.4), ("a", 3, at(2), 0.4), ("a", 4, at(3), 0.9), ("b", 5, at(1), 0.3), ("b", 6, at(2), None),
            ("c", 7, at(4), 1.5), ("c", 8, at(5), 2.0)]
    table = lambda some: spark.createDataFrame(some, schema)
    path, out, mark = (scratch_path(spark, n) for n in ("usage", "alerts", "mark"))
    stream = lambda: spend.stream_spend_alerts(spark.readStream.schema(schema).parquet(path), 1.0, "30 minutes")
    # Late turns first, the same turns again, then time moves on; after the alerts one turn is played again.
    for some in ([rows[3], rows[2], rows[7]], [rows[2], rows[0], rows[4]], [rows[1], rows[5], rows[6], rows[0]],
                 [("z", 9, at(600), 0.0)], [rows[3], ("a", 10, at(650), 9.0)], [("z", 11, at(900), 0.0)]):
        table(some).coalesce(1).write.mode("append").parquet(path)
        drive(stream(), out, mark)
    got = sorted((r["conversation_id"], r["seq"], round(r["running"], 6)) for r in spark.read.parquet(out).collect())
    want = sorted((r["conversation_id"], r["seq"], round(r["running"], 6)) for r in spend.spend_alerts(table(rows), 1.0).collect())
    assert got == want == [("a", 3, 1.2), ("c", 7, 1.5)]


def test_ranges_of_numbers():
    ranges, fresh = add_numbers([], [3, 1, 2, 7, 3])
    assert ranges == [1, 3, 7, 7] and fresh == {1, 2, 3, 7}
    assert add_numbers(ranges, [2, 4, 6, 9]) == ([1, 4, 6, 7, 9, 9], {4, 6, 9})


def test_late_lines_go_to_their_own_table(spark):
    line = lambda text: json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}})
    start = datetime(2024, 1, 1)
    rows = lambda *some: spark.createDataFrame([(c, 1, seq, start + timedelta(minutes=m), line(f"{c}{seq}")) for c, seq, m in some],
                                               "conversation_id string, turn long, seq long, ts timestamp, line string")
    path, out, late, mark = (scratch_path(spark, n) for n in ("lines", "events", "late", "mark"))
    source = lambda: spark.readStream.schema("conversation_id string, turn long, seq long, ts timestamp, line string").parquet(path)
    # The second batch lets the watermark pass the first; the third brings a line from before it, and one again.
    for some in ([("a", 0, 0), ("a", 1, 1)], [("b", 0, 300)], [("a", 2, 2), ("b", 1, 301), ("b", 0, 300)]):
        rows(*some).coalesce(1).write.mode("append").parquet(path)
        write_events(source(), out, late, mark).awaitTermination(240)
    assert sorted(r["text"] for r in read_events(spark, out).collect()) == ["a0", "a1", "b0", "b1"]
    assert [(r["conversation_id"], r["seq"], r["line"]) for r in read_late(spark, late).collect()] == [("a", 2, line("a2"))]
    # Four hours of silence ended the first turn: nothing of it is kept.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "turn").load(mark)
    assert [r["key"]["conversation_id"] for r in state.select("key").collect()] == ["b"]
