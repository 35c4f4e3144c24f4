"""Model event streams as tables: parsed lines to typed events, usage and accumulated text.

lines(conversation_id, turn, seq, line). All windows are per conversation and turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.render import is_memory_tool, parse_citations, retryable, summarize_tool_text
from memloom.schemas import EVENT_BLOCKS, EVENT_LINE

KEY = ["conversation_id", "turn"]
COLUMNS = {
    "type": "string", "text": "string", "tool_id": "string", "name": "string", "input": "string",
    "ok": "boolean", "summary": "string", "code": "string", "message": "string", "retryable": "boolean",
    "citations": "array<struct<item_id:string,type:string,day:string,source:string,snippet:string>>",
    "session_id": "string", "input_tokens": "bigint", "output_tokens": "bigint",
    "cost_usd": "double", "stop_reason": "string",
}
LOST = "): memory was not consulted for this answer."
MUTE = "None of the tools in this session reads memory although a server is connected; allow its tools. Servers: "
NO_REASON = "the run ended in an error without a message"


def parse_lines(raw: DataFrame) -> DataFrame:
    """Trimmed, non-blank, valid JSON lines with their parsed form; the rest is dropped."""
    line = F.trim(F.col("line"))
    kept = raw.withColumn("line", line).where((line != "") & F.try_parse_json(line).isNotNull())
    return kept.withColumn("e", F.from_json("line", EVENT_LINE)).where(F.col("e").isNotNull())


def _blocks(content: Column) -> Column:
    return F.when(content.startswith("["), F.from_json(content, EVENT_BLOCKS))


def _emit(df: DataFrame, idx: Column, **values: Column) -> DataFrame:
    return df.select(
        *KEY, "seq", idx.cast("long").alias("idx"),
        *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()],
    )


def _list(rows: Column, schema: str) -> Column:
    return F.coalesce(rows, F.array()).cast(f"array<struct<{schema}>>")


def texts_of_line() -> Column:
    """(idx, text) of a streamed delta, or of each text block of a whole assistant message."""
    delta = F.when(
        (F.col("e.type") == "content_block_delta") & (F.col("e.delta.type") == "text_delta") & F.col("e.delta.text").isNotNull(),
        F.array(F.struct(F.lit(0).alias("idx"), F.col("e.delta.text").alias("text"))),
    )
    told = F.transform(_blocks(F.col("e.message.content")), lambda b, i: F.struct(
        (i * 2).alias("idx"), F.when(b["type"] == "text", b["text"]).alias("text")))
    whole = F.when(F.col("e.type") == "assistant", F.filter(told, lambda t: t["text"].isNotNull()))
    return _list(F.coalesce(delta, whole), "idx:bigint,text:string")


def starts_of_line() -> Column:
    """(idx, tool_id, name, input) of each tool call that a line begins."""
    block = F.col("e.content_block")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    call = lambda idx, b, name: F.struct(
        idx.alias("idx"), b["id"].alias("tool_id"), name.alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("input"))
    streamed = F.when(
        (F.col("e.type") == "content_block_start") & (block["type"] == "tool_use") & given(block["id"]) & given(block["name"]),
        F.array(call(F.lit(0), block, block["name"])),
    )
    told = F.transform(_blocks(F.col("e.message.content")), lambda b, i: F.when(
        b["type"] == "tool_use", call(i * 2, b, F.coalesce(b["name"], F.lit("unknown")))))
    whole = F.when(F.col("e.type") == "assistant", F.filter(told, lambda t: t["tool_id"].isNotNull()))
    return _list(F.coalesce(streamed, whole), "idx:bigint,tool_id:string,name:string,input:string")


def results_of_line() -> Column:
    """(idx, tool_id, ok, body) of each tool result in a line."""
    told = F.transform(_blocks(F.col("e.message.content")), lambda b, i: F.when(b["type"] == "tool_result", F.struct(
        (i * 2).alias("idx"), F.coalesce(b["tool_use_id"], F.lit("")).alias("tool_id"),
        (~F.coalesce(b["is_error"], F.lit(False))).alias("ok"), _plain_text(b["content"]).alias("body"))))
    return _list(F.when(F.col("e.type") == "user", F.filter(told, lambda t: t.isNotNull())), "idx:bigint,tool_id:string,ok:boolean,body:string")


def _each(parsed: DataFrame, rows: Column) -> DataFrame:
    return parsed.select(*KEY, "seq", F.inline(rows))


def translate_delta(parsed: DataFrame) -> DataFrame:
    """Streamed deltas and whole assistant text blocks as message.delta."""
    return _emit(_each(parsed, texts_of_line()), F.col("idx"), type=F.lit("message.delta"), text=F.col("text"))


def translate_tool_start(parsed: DataFrame) -> DataFrame:
    return _emit(_each(parsed, starts_of_line()), F.col("idx"), type=F.lit("tool.start"),
                 tool_id=F.col("tool_id"), name=F.col("name"), input=F.col("input"))


def _plain_text(content: Column) -> Column:
    parts = F.from_json(content, "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.when(content.startswith("[") & parts.isNotNull(), F.array_join(texts, "\n")).otherwise(
        F.coalesce(content, F.lit(""))
    )


def tool_pairing(results: DataFrame, starts: DataFrame) -> DataFrame:
    """Name each result(tool_id, seq, idx) by the latest start of that tool id before it."""
    both = results.withColumn("_result", F.lit(True)).unionByName(
        starts.select(*KEY, "seq", "idx", "tool_id", F.col("name").alias("_name")), allowMissingColumns=True
    )
    before = Window.partitionBy(*KEY, "tool_id").orderBy("seq", "idx").rowsBetween(Window.unboundedPreceding, -1)
    named = both.withColumn("name", F.coalesce(F.last("_name", ignorenulls=True).over(before), F.lit("unknown")))
    return named.where(F.col("_result")).drop("_result", "_name")


def translate_tool_result(parsed: DataFrame) -> DataFrame:
    """tool.result with its tool's name, and citation events of memory tools."""
    raw = _each(parsed, results_of_line())
    named = tool_pairing(raw, translate_tool_start(parsed))
    summary = F.when(F.col("ok"), summarize_tool_text(F.col("name"), F.col("body"))).otherwise(F.left("body", F.lit(200)))
    told = _emit(named, F.col("idx"), type=F.lit("tool.result"), tool_id=F.col("tool_id"), name=F.col("name"),
                 ok=F.col("ok"), summary=summary)
    return told.unionByName(stream_citations(named))


def stream_citations(named_results: DataFrame) -> DataFrame:
    cited = named_results.where(F.col("ok") & is_memory_tool(F.col("name"))).withColumn("c", parse_citations(F.col("body")))
    return _emit(cited.where(F.size("c") > 0), F.col("idx") + 1, type=F.lit("citation"), tool_id=F.col("tool_id"), citations=F.col("c"))


def init_faults() -> Column:
    """Messages of an init line: servers that did not connect, or no memory tools at all; null where all is well."""
    status = lambda s: F.coalesce(s["status"], F.lit("unknown"))
    servers = F.coalesce("e.mcp_servers", F.array().cast(EVENT_LINE["mcp_servers"].dataType))
    down = F.filter(servers, lambda s: status(s) != "connected")
    lost = F.transform(down, lambda s: F.concat(
        F.lit("MCP server "), F.coalesce(s["name"], F.lit("without a name")), F.lit(" is not connected (status: "), status(s), F.lit(LOST)))
    names = F.array_join(F.transform(servers, lambda s: F.coalesce(s["name"], F.lit("?"))), ", ")
    mute = F.concat(F.lit(MUTE), names)
    memory = F.exists(F.coalesce("e.tools", F.array().cast("array<string>")), lambda t: is_memory_tool(t, wide=True))
    return F.when(F.size(down) > 0, lost).when((F.size(servers) > 0) & ~memory, F.array(mute))


def is_init() -> Column:
    return F.coalesce((F.col("e.type") == "system") & (F.col("e.subtype") == "init"), F.lit(False))


def stream_init_errors(parsed: DataFrame) -> DataFrame:
    """Errors of the first init line of a turn."""
    first = Window.partitionBy(*KEY).orderBy("seq")
    init = parsed.where(is_init()).withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    rows = init.select(*KEY, "seq", F.posexplode(init_faults()).alias("pos", "m"))
    code = F.lit("upstream_failed")
    return _emit(rows, F.col("pos"), type=F.lit("error"), code=code, message=F.col("m"), retryable=retryable(code))


def session_id_asof(parsed: DataFrame) -> DataFrame:
    """The session id known after each line."""
    so_far = Window.partitionBy(*KEY).orderBy("seq")
    return parsed.withColumn("session_id", F.last("e.session_id", ignorenulls=True).over(so_far))


def text_accumulate(parsed: DataFrame) -> DataFrame:
    """The whole assistant text of each turn, in order of arrival."""
    deltas = translate_delta(parsed)
    listed = F.array_sort(F.collect_list(F.struct("seq", "idx", "text")))
    return deltas.groupBy(*KEY).agg(F.array_join(F.transform(listed, lambda d: d["text"]), "").alias("text"))


def has_text() -> Column:
    """Whether a line carries any assistant text."""
    late = (F.col("e.type") == "result") & ~F.coalesce("e.is_error", F.lit(False)) & (F.length("e.result") > 0)
    return F.coalesce(late, F.lit(False)) | F.exists(texts_of_line(), lambda t: F.length(t["text"]) > 0)


def _with_totals(parsed: DataFrame) -> DataFrame:
    """Running usage, cost, stop reason and whether text was seen, as of each line."""
    so_far = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("e.type")
    rows = session_id_asof(parsed).withColumn("_spoke", has_text())
    for name in ("input_tokens", "output_tokens"):
        added = F.when(kind == "assistant", F.coalesce(f"e.message.usage.{name}", F.lit(0))).otherwise(0)
        told = F.when(kind == "result", F.col(f"e.usage.{name}"))
        running = F.sum(added).over(so_far)
        # A result's own usage replaces the sum so far; later messages add to it again.
        rows = rows.withColumn(f"_sum_{name}", running).withColumn(f"_shift_{name}", told - F.col(f"_sum_{name}"))
        rows = rows.withColumn(
            name, F.col(f"_sum_{name}") + F.coalesce(F.last(f"_shift_{name}", ignorenulls=True).over(so_far), F.lit(0))
        )
    stop = F.when(kind == "assistant", F.nullif(F.col("e.message.stop_reason"), F.lit("")))
    return rows.withColumns({
        "cost_usd": F.last(F.when(kind == "result", F.col("e.total_cost_usd")), ignorenulls=True).over(so_far),
        "stop_reason": F.last(stop, ignorenulls=True).over(so_far),
        "_spoken": F.coalesce(F.max("_spoke").over(before), F.lit(False)),
    })


def stream_result_event(parsed: DataFrame) -> DataFrame:
    """The end of a turn: an error, or the final text if none came before, then message.done."""
    results = _with_totals(parsed).where(F.col("e.type") == "result")
    failed = F.coalesce("e.is_error", F.lit(False))
    code = F.lit("runner_failed")
    errors = _emit(results.where(failed), F.lit(0), type=F.lit("error"), code=code,
                   message=F.coalesce("e.result", F.lit(NO_REASON)), retryable=retryable(code))
    fine = results.where(~failed)
    late = _emit(fine.where(~F.col("_spoken") & (F.length("e.result") > 0)), F.lit(0),
                 type=F.lit("message.delta"), text=F.col("e.result"))
    done = _emit(fine, F.lit(1), type=F.lit("message.done"), session_id=F.col("session_id"),
                 input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"),
                 cost_usd=F.col("cost_usd"), stop_reason=F.col("stop_reason"))
    return reduce(DataFrame.unionByName, [errors, late, done])


def usage_rollup(parsed: DataFrame) -> DataFrame:
    """Tokens, cost and stop reason of each turn after its last line."""
    totals = _with_totals(parsed)
    last = lambda c: F.max_by(c, "seq").alias(c)
    return totals.groupBy(*KEY).agg(*[last(c) for c in ("input_tokens", "output_tokens", "cost_usd", "stop_reason", "session_id")])


_MEMORY, _OTHER = "mcp__memory__memory_search", "other"

#: One fact of a line: an event that is complete, or one that the lines before it complete.
FACT = {
    "fact": "string", "idx": "bigint", "text": "string", "tool_id": "string", "name": "string", "input": "string", "ok": "boolean", "summary": "string",
    "memory_summary": "string", "citations": COLUMNS["citations"], "message": "string", "session_id": "string", "said": "boolean", "add_in": "bigint",
    "add_out": "bigint", "told_in": "bigint", "told_out": "bigint", "cost_usd": "double", "stop_reason": "string",
}


def _fact(**values: Column) -> Column:
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in FACT.items()])


def line_facts() -> Column:
    """array of facts of one parsed line, in order of idx; the line itself comes first."""
    kind, failed = F.col("e.type"), F.coalesce("e.is_error", F.lit(False))
    used = lambda name: F.when(kind == "assistant", F.coalesce(f"e.message.usage.{name}", F.lit(0))).otherwise(0)
    told = lambda name: F.when(kind == "result", F.col(f"e.usage.{name}"))
    end = F.when(kind == "result", F.when(failed, "failed").otherwise("done"))
    line = _fact(
        fact=F.coalesce(end, F.when(is_init(), "init"), F.lit("line")), idx=F.lit(-1), text=F.when(kind == "result", F.col("e.result")),
        session_id=F.col("e.session_id"), said=has_text(), add_in=used("input_tokens"), add_out=used("output_tokens"),
        told_in=told("input_tokens"), told_out=told("output_tokens"), cost_usd=F.when(kind == "result", F.col("e.total_cost_usd")),
        stop_reason=F.when(kind == "assistant", F.nullif(F.col("e.message.stop_reason"), F.lit(""))))
    texts = F.transform(texts_of_line(), lambda t: _fact(fact=F.lit("text"), idx=t["idx"], text=t["text"]))
    starts = F.transform(starts_of_line(), lambda t: _fact(fact=F.lit("start"), idx=t["idx"], tool_id=t["tool_id"], name=t["name"], input=t["input"]))
    summary = lambda t, name: F.when(t["ok"], summarize_tool_text(F.lit(name), t["body"])).otherwise(F.left(t["body"], F.lit(200)))
    results = F.transform(results_of_line(), lambda t: _fact(
        fact=F.lit("tool"), idx=t["idx"], tool_id=t["tool_id"], ok=t["ok"], summary=summary(t, _OTHER), memory_summary=summary(t, _MEMORY),
        citations=F.when(t["ok"], parse_citations(t["body"]))))
    faults = F.transform(F.when(is_init(), init_faults()), lambda m, i: _fact(fact=F.lit("fault"), idx=i, message=m))
    none = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in FACT.items()) + ">>")
    return F.concat(F.array(line), *[F.coalesce(x, none) for x in (faults, texts, starts, results)])


def _event(idx: Column, **values: Column) -> Column:
    return F.struct(idx.cast("long").alias("at"), *[values.get(c, F.lit(None)).cast(t).alias(f"_{c}") for c, t in COLUMNS.items()])


def translate_lines(raw: DataFrame) -> DataFrame:
    """All typed events of all turns; order within a turn is (seq, idx).

    Lines are read and parsed once. One shuffle brings a turn's facts together, and windows over it give each
    what the lines before it decide.
    """
    facts = parse_lines(raw).select(*KEY, "seq", F.inline(line_facts()))
    order = Window.partitionBy(*KEY).orderBy("seq", "idx")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    same_tool = Window.partitionBy(*KEY, "tool_id").orderBy("seq", "idx").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("fact")
    last = lambda c, over: F.last(c, ignorenulls=True).over(over)
    known = facts.withColumns({
        "_session": last("session_id", so_far), "_cost": last("cost_usd", so_far), "_stop": last("stop_reason", so_far),
        "_spoken": F.coalesce(F.max("said").over(before), F.lit(False)),
        "_first": F.min(F.when(kind == "init", F.col("seq"))).over(Window.partitionBy(*KEY)),
        "_in": F.sum("add_in").over(so_far), "_out": F.sum("add_out").over(so_far),
        "_called": F.coalesce(last(F.when(kind == "start", F.col("name")), same_tool), F.lit("unknown")),
    })
    # A result's own usage replaces the sum so far; later messages add to it again.
    total = lambda n: F.col(f"_{n}") + F.coalesce(last(F.col(f"told_{n}") - F.col(f"_{n}"), so_far), F.lit(0))
    known = known.withColumns({"_total_in": total("in"), "_total_out": total("out")})
    memory, has = is_memory_tool(F.col("_called")), F.length("text") > 0
    idx, fault = F.col("idx"), lambda code: {"type": F.lit("error"), "code": F.lit(code), "retryable": retryable(F.lit(code))}
    main = (
        F.when((kind == "fault") & (F.col("seq") == F.col("_first")), _event(idx, message=F.col("message"), **fault("upstream_failed")))
        .when(kind == "text", _event(idx, type=F.lit("message.delta"), text=F.col("text")))
        .when(kind == "start", _event(idx, type=F.lit("tool.start"), tool_id=F.col("tool_id"), name=F.col("name"), input=F.col("input")))
        .when(kind == "tool", _event(idx, type=F.lit("tool.result"), tool_id=F.col("tool_id"), name=F.col("_called"), ok=F.col("ok"),
                                     summary=F.when(memory, F.col("memory_summary")).otherwise(F.col("summary"))))
        .when(kind == "failed", _event(F.lit(0), message=F.coalesce("text", F.lit(NO_REASON)), **fault("runner_failed")))
        .when(kind == "done", _event(F.lit(1), type=F.lit("message.done"), session_id=F.col("_session"), input_tokens=F.col("_total_in"),
                                     output_tokens=F.col("_total_out"), cost_usd=F.col("_cost"), stop_reason=F.col("_stop")))
    )
    more = (
        F.when((kind == "tool") & memory & F.col("ok") & (F.size("citations") > 0),
               _event(idx + 1, type=F.lit("citation"), tool_id=F.col("tool_id"), citations=F.col("citations")))
        .when((kind == "done") & ~F.col("_spoken") & has, _event(F.lit(0), type=F.lit("message.delta"), text=F.col("text")))
    )
    told = known.select(*KEY, "seq", F.inline(F.array_compact(F.array(main, more))))
    return told.select(*KEY, "seq", F.col("at").alias("idx"), *[F.col(f"_{c}").alias(c) for c in COLUMNS])
