"""Greedy packing of ranked items into a token budget, one fold per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.render import item_label
from memloom.functions.text import flatten_space, normalize_text, snippet_of, tokenize
from memloom.functions.tokens import estimate_tokens, truncate_to_tokens

HEADER = "Relevant memory. Cite an item by its id when you use it."

# Limits of the packer.
ITEM_SHARE = 0.35
ITEM_FLOOR = 32
MIN_REMAINING = 16
MIN_BODY = 8
SNIPPET_CHARS = 400
CITATION_CHARS = 200

_STATE = "struct<used:bigint,omitted:bigint,lines:array<string>,cited:array<struct<position:int,body_tokens:bigint>>>"


def _let(value: Column, body) -> Column:
    """Bind a value once inside an interpreted lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with what packing needs of their content, instead of the content."""
    flat = candidates.withColumns({
        "_flat": flatten_space(F.col("content")), "_needles": tokenize(F.col("query")),
    })
    hay = flat.withColumn("_hay", normalize_text(F.col("_flat")))
    return hay.withColumns({
        "_text": snippet_of(F.col("_flat"), F.col("_hay"), F.col("_needles"), SNIPPET_CHARS),
        "_cite": snippet_of(F.col("_flat"), F.col("_hay"), F.col("_needles"), CITATION_CHARS),
        "_label": item_label(F.col("item_id"), F.col("type"), F.col("created_at"), F.col("source")),
    }).withColumn("_cost", estimate_tokens(F.col("_label")) + 2).drop("content", "_flat", "_hay", "_needles")


def pack_context(
    candidates: DataFrame,
    max_tokens: int,
    header: str = HEADER,
    item_share: float = ITEM_SHARE,
) -> DataFrame:
    """One row per query: context, citations, used tokens, omitted count.

    candidates(query_id, query, position, item_id, type, content, source, created_at, fused, ranks).
    A candidate that does not fit is skipped and the next one is tried. Candidates may be `prepared` before.
    """
    budget = max(0, max_tokens)
    cap = max(ITEM_FLOOR, int(budget * item_share))
    header_cost = estimate_tokens(F.lit(header))
    fields = F.struct(
        F.col("position").cast("int").alias("position"), "item_id", "type", "source", "created_at",
        "fused", "ranks", "_text", "_cite", "_label", "_cost",
    )
    in_order = lambda a, b: a["position"] - b["position"]
    ready = candidates if "_text" in candidates.columns else prepared(candidates)
    listed = ready.groupBy("query_id").agg(F.array_sort(F.collect_list(fields), in_order).alias("_c"))

    def step(acc: Column, c: Column) -> Column:
        remaining = F.lit(budget) - acc["used"]
        room = F.least(F.lit(cap), remaining) - c["_cost"]
        fits = (remaining > MIN_REMAINING) & (room > MIN_BODY)
        body = F.when(fits, truncate_to_tokens(c["_text"], room)).otherwise("")
        skipped = F.struct(
            acc["used"].alias("used"), (acc["omitted"] + 1).alias("omitted"),
            acc["lines"].alias("lines"), acc["cited"].alias("cited"),
        ).cast(_STATE)

        def taken(line: Column) -> Column:
            cost = estimate_tokens(line) + 1
            cited = F.struct(c["position"].alias("position"), cost.alias("body_tokens"))
            return F.struct(
                (acc["used"] + cost).alias("used"), acc["omitted"].alias("omitted"),
                F.concat(acc["lines"], F.array(line)).alias("lines"),
                F.concat(acc["cited"], F.array(cited)).alias("cited"),
            ).cast(_STATE)

        return _let(
            body,
            lambda b: F.when(b == "", skipped).otherwise(
                _let(F.concat(c["_label"], F.lit("\n"), b), taken)
            ),
        )

    start = F.struct(
        header_cost.alias("used"), F.lit(0).alias("omitted"),
        F.array().cast("array<string>").alias("lines"),
        F.array().cast("array<struct<position:int,body_tokens:bigint>>").alias("cited"),
    ).cast(_STATE)
    folded = listed.withColumn("_s", F.aggregate("_c", start, step))
    shown = F.transform(F.col("_s.cited"), lambda x: x["position"])
    cited = F.transform(
        F.filter("_c", lambda c: F.array_contains(shown, c["position"])),
        lambda c: F.struct(
            c["item_id"].alias("id"), c["type"].alias("type"), c["source"].alias("source"),
            c["created_at"].alias("timestamp"), F.round(c["fused"], 6).alias("score"),
            c["ranks"].alias("ranks"), c["_cite"].alias("snippet"),
        ),
    )
    empty = F.size(F.col("_s.lines")) == 0
    text = F.concat(F.lit(header + "\n\n"), F.array_join(F.col("_s.lines"), "\n\n"))
    return folded.select(
        "query_id",
        F.when(empty, "").otherwise(text).alias("context"),
        cited.alias("citations"),
        F.when(empty, F.lit(0)).otherwise(F.col("_s.used")).alias("used_tokens"),
        F.col("_s.omitted").alias("packed_omitted"),
    )


def pack_items(items: DataFrame, max_tokens: int, header: str = HEADER) -> DataFrame:
    """Pack rows that have no ranks: (query_id, context)."""
    plain = items.withColumns({
        "fused": F.lit(0.0), "ranks": F.create_map().cast("map<string,int>"),
    })
    return pack_context(plain, max_tokens, header).select("query_id", "context")
