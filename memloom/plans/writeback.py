"""Transcripts to candidate items through a pluggable fact extractor."""

from __future__ import annotations

import json
import re
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.render import js_trim
from memloom.operators.conversations import recent_tail
from memloom.operators.items import confidence_floor
from memloom.schemas import MEMORY_TYPES, SCOPE

MIN_CONFIDENCE = 0.6
DEFAULT_CONFIDENCE = 0.7
MIN_FACT_CHARS = 8

Extractor = Callable[[str], str]

_TOKENS = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{}]', re.S)


def _first_object(text: str | None) -> str | None:
    """The first balanced {...}; braces inside JSON strings do not count."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for token in _TOKENS.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0:
            return text[start:token.end()]
    return None


def extract_json_object(text: Column) -> Column:
    """The first balanced JSON object of a text: bracket matching is beyond regular expressions."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_first_object)

    return run(text)


def parse_facts(raw: DataFrame, column: str = "raw", most_entities: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, errors): each usable fact of the extractor's answers, and answers that are not JSON.

    A bad entry costs one fact, not the answer it came in.
    """
    found = raw.withColumn("_json", extract_json_object(F.col(column)))
    ok = F.try_parse_json("_json").isNotNull()
    reason = F.when(F.col("_json").isNull(), "no JSON object").when(~ok, "invalid JSON")
    marked = found.withColumn("error", reason)
    errors = marked.where(F.col("error").isNotNull()).drop("_json")
    listed = F.from_json("_json", "struct<facts:array<string>>")["facts"]
    fact = ("struct<type:string,content:string,confidence:double,"
            "entities:array<struct<name:string,kind:string>>>")
    facts = (
        marked.where(F.col("error").isNull()).drop("error", column)
        .select("*", F.posexplode(listed).alias("fact_pos", "_raw"))
        .where(F.col("_raw").startswith("{"))
        .withColumn("_f", F.from_json("_raw", fact))
    )
    # A number in quotes is not a number: the raw value decides whether the confidence counts.
    plain = F.get_json_object("_raw", "$.confidence")
    quoted = F.col("_raw").rlike(r'"confidence"\s*:\s*"')
    confidence = F.when(plain.isNull() | quoted, F.lit(DEFAULT_CONFIDENCE)).otherwise(
        F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), plain.try_cast("double"))), F.lit(DEFAULT_CONFIDENCE))
    )
    named = F.filter(
        F.transform(
            F.coalesce("_f.entities", F.array().cast("array<struct<name:string,kind:string>>")),
            lambda e: F.struct(js_trim(F.coalesce(e["name"], F.lit(""))).alias("name"), e["kind"].alias("kind")),
        ),
        lambda e: e["name"] != "",
    )
    shaped = facts.withColumns({
        "type": F.col("_f.type"), "content": js_trim(F.coalesce("_f.content", F.lit(""))),
        "confidence": confidence, "entities": named if most_entities is None else F.slice(named, 1, most_entities),
    })
    good = F.col("type").isin(MEMORY_TYPES) & (F.length("content") >= MIN_FACT_CHARS)
    return shaped.where(good).drop("_json", "_raw", "_f"), errors


def sentence_extractor(transcript: str) -> str:
    """Deterministic rules for tests: user sentences that state a preference or a choice."""
    facts = []
    for block in transcript.split("\n\n"):
        if not block.startswith("User: "):
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", block[6:]):
            low = sentence.lower()
            kind = "preference" if "prefer" in low else "decision" if "because" in low else "note"
            facts.append({"type": kind, "content": sentence.strip(), "confidence": 0.9 if kind != "note" else 0.65})
    return json.dumps({"facts": facts})


def extract(transcripts: DataFrame, extractor: Extractor = sentence_extractor) -> DataFrame:
    """Run the extractor over (.., transcript) in Arrow batches; adds `raw`."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extractor)

    return transcripts.withColumn("raw", run(F.col("transcript")))


def transcript_to_candidates(
    messages: DataFrame, extractor: Extractor = sentence_extractor, floor: float = MIN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) from messages(conversation_id, scope, turn, role, text)."""
    scopes = messages.groupBy("conversation_id").agg(*[F.first(c).alias(c) for c in SCOPE])
    raw = extract(recent_tail(messages), extractor).drop("transcript").join(scopes, "conversation_id")
    facts, errors = parse_facts(raw)
    kept = confidence_floor(facts, floor).where(F.col("reason").isNull()).drop("reason")
    stamped = kept.withColumn("source", F.concat(F.lit("conversation:"), "conversation_id"))
    return stamped, errors
