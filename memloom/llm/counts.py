"""Token counts of texts of any length by overlap resynchronisation.

A huge text is cut into chunks that overlap their successor. Chunks are encoded apart, in any task, and two
neighbours are spliced where both provably have a boundary of the whole text's encoding:

* Chunks begin and end at characters that no normalisation joins to the one before, so each is a true
  stretch of the normalised text.
* Pre-tokens are found by a scan that looks forward only. Once both scans start a pre-token at the same
  place, away from both edges by more than the longest look-ahead or special token, they agree until the
  left chunk nears its end; there everything before is the left chunk's, everything after the right one's.
* Where the whole overlap lies in one pre-token, merges decide. A sequence of tokens is the encoding of its
  text exactly if each adjacent pair is the encoding of its own text (the first merge across a boundary would
  happen in the pair alone just as well). The left encoding up to a token that both have over the same span,
  and the right one after it, hold only pairs that one of the two vouches for.

If neither is found the left chunk is lengthened into its successor, four times as far each time. A text
whose chunks never agree is put together again and encoded whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.flat import pieces
from memloom.llm.vocab import Tokens, count_memory, load
from memloom.session import cut_lineage

CHUNK = 1 << 16
OVERLAP = 1 << 10
GUARD = 64
_FIELDS = ("ids", "starts", "ends", "words", "whole")


def stable(c: str) -> bool:
    """Whether normalisation to NFC never joins this character to those before it."""
    o = ord(c)
    return o < 0x300 or not (unicodedata.category(c)[0] == "M" or 0x1160 <= o <= 0x11FF or 0x16D63 <= o <= 0x16D6A)


def _stable_from(text: str, at: int) -> int:
    """The first place from `at` on where a chunk may begin or end."""
    while at < len(text) and not stable(text[at]):
        at += 1
    return min(at, len(text))


def cut_text(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, end) of the chunks: each overlaps the next, and none reaches into the next but one."""
    spans, first, end = [], 0, 0
    while True:
        after = _stable_from(text, max(first + chunk, end))
        end = _stable_from(text, after + overlap)
        if end >= len(text):
            return [*spans, (first, len(text))]
        spans.append((first, end))
        first = after


def splice(left: Tokens, right: Tokens, begin: int, end: int, guard: int = GUARD) -> tuple[int, int] | None:
    """How many tokens of the left and of the right list lie before a proven common boundary in [begin, end).

    Spans of both lists count from the same origin; `begin` is where the right chunk starts, `end` where the
    left one ends. None if nothing is proven.
    """
    def fresh(t: Tokens) -> np.ndarray:
        return t.whole & np.append(True, t.words[1:] != t.words[:-1])[:len(t.ids)]

    low, high = begin + guard, end - guard
    # A list's first token starts a pre-token only if more of the text's tokens stand before it.
    a = np.flatnonzero(fresh(left) & (left.starts >= low) & (left.starts <= high))
    b = np.flatnonzero(fresh(right) & (right.starts >= low) & (right.starts <= high))
    a, b = a[a > 0], b[b > 0]
    _, i, j = np.intersect1d(left.starts[a], right.starts[b], return_indices=True)
    if len(i):
        middle = len(i) // 2
        return int(a[i[middle]]), int(b[j[middle]])
    for t in (left, right):
        inside = np.flatnonzero((t.ends > begin) & (t.starts < end))
        # One pre-token from the start of the overlap, or before it, to its end, or beyond it.
        if not len(inside) or t.starts[inside[0]] > begin or t.ends[inside[-1]] < end or len(set(t.words[inside].tolist())) > 1:
            return None
    a = np.flatnonzero(left.whole & (left.starts >= low) & (left.ends <= high))
    b = np.flatnonzero(right.whole & (right.starts >= low) & (right.ends <= high))
    width = int(max(left.ids.max(initial=0), right.ids.max(initial=0))) + 1
    span = end - begin + 1
    key = lambda t, at: ((t.starts[at] - begin) * span + (t.ends[at] - begin)) * width + t.ids[at]
    _, i, j = np.intersect1d(key(left, a), key(right, b), return_indices=True)
    if not len(i):
        return None
    middle = len(i) // 2
    return int(a[i[middle]]) + 1, int(b[j[middle]]) + 1


def guard_of(model) -> int:
    return max([GUARD, *(2 * len(s) for s in model.special)])


def _moved(tokens: Tokens, by: int) -> Tokens:
    return Tokens(tokens.ids, tokens.starts + by, tokens.ends + by, tokens.words, tokens.whole)


def _head(tokens: Tokens, end: int) -> int:
    """How many tokens begin before `end`."""
    return int(np.searchsorted(tokens.starts, end, "left"))


def widened(model, left: str, right: str, start: int, fixed: int, free: int) -> tuple[int, int] | None:
    """Splice the chunk `left` with its successor `right`, which starts `start` characters into it, by longer overlaps.

    The tokens of `left` that begin before `fixed` must stay, for a splice with its predecessor lies there;
    the longer overlap stays within the first `free` characters of `right`, for after them its own successor begins.
    """
    base, after = model.tokens(left), _moved(model.tokens(right), start)
    known = reach = len(left) - start
    while reach < free:
        reach = min(4 * reach, free)
        # The whole of `right`, or up to a character that may end a chunk.
        stop = reach if reach == len(right) or stable(right[reach]) else max(known, _stable_from(right, reach))
        longer = model.tokens(left + right[known:stop])
        n = _head(base, fixed)
        if not all(np.array_equal(getattr(base, f)[:n], getattr(longer, f)[:n]) for f in ("ids", "starts", "ends")):
            return None
        found = splice(longer, after, start, start + stop, guard_of(model))
        if found:
            return found
    return None


def encode_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of one text, encoded chunk by chunk, so that the library never holds more than a chunk and its overlap."""
    spans = cut_text(text, chunk, overlap)
    parts, low, now = [], 0, model.tokens(text[slice(*spans[0])])
    now = _moved(now, spans[0][0])
    for (_, end), (start, stop) in zip(spans, spans[1:]):
        after = _moved(model.tokens(text[start:stop]), start)
        found = splice(now, after, start, end, guard_of(model))
        if found is None or found[0] < low:
            return np.array(model.ids([text])[0], dtype=np.int64)
        parts.append(now.ids[low:found[0]])
        low, now = found[1], after
    parts.append(now.ids[low:])
    return np.concatenate(parts)


def _cut_schema(keep: T.StructType) -> T.StructType:
    return T.StructType([*keep.fields, *(T.StructField(n, t) for n, t in (
        ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("huge", T.LongType()), ("chunk", T.IntegerType()),
        ("last", T.BooleanType()), ("first", T.LongType()), ("stop", T.LongType()), ("fixed", T.LongType()), ("free", T.LongType()),
        ("text", T.StringType())))])


def _cut(rows: DataFrame, keep: list[str], path: str, chunk: int, overlap: int) -> DataFrame:
    """A row per text with its count, null if it is huge, and a row per chunk of the huge ones."""
    schema = _cut_schema(rows.select(*keep).schema)
    arrow_types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, number = count_memory(path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [t or "" for t in piece.column(len(keep)).to_pylist()]
                huge = [len(t) > chunk + 2 * overlap for t in texts]
                counts = map(sum, memory.of([t for t, h in zip(texts, huge) if not h]))
                at, rest = [], []
                for i, (text, large) in enumerate(zip(texts, huge)):
                    at.append(i)
                    n_bytes = len(text.encode())
                    if not large:
                        rest.append((n_bytes, next(counts), *[None] * 8))
                        continue
                    number += 1
                    rest.append((n_bytes, None, number, *[None] * 7))
                    spans = cut_text(text, chunk, overlap)
                    for n, (first, stop) in enumerate(spans):
                        at.append(i)
                        fixed = spans[n - 1][1] if n else first
                        free = spans[n + 1][0] if n + 1 < len(spans) else stop
                        rest.append((None, None, number, n, n + 1 == len(spans), first, stop, fixed, free, text[first:stop]))
                kept = [c.take(pa.array(at)) for c in piece.columns[:len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rest), arrow_types))], schema.names)

    return rows.mapInArrow(run, schema)


_LIST = "struct<ids: array<long>, starts: array<long>, ends: array<long>, words: array<long>, whole: array<boolean>>"


def _listed(tokens: Tokens) -> dict:
    return {f: getattr(tokens, f).tolist() for f in _FIELDS}


def _told(row: dict) -> Tokens:
    return Tokens(*(np.array(row[f], dtype=bool if f == "whole" else np.int64) for f in _FIELDS))


def _encode_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Counts of the chunks and the tokens at both ends: those that begin, and those that end, in an overlap."""
    schema = f"huge long, chunk int, last boolean, first long, stop long, n long, skipped long, head {_LIST}, tail {_LIST}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                for r in piece.to_pylist():
                    t = _moved(model.tokens(r["text"]), r["first"])
                    n, skipped = _head(t, r["fixed"]), int(np.searchsorted(t.ends, r["free"], "right"))
                    out.append({**{k: r[k] for k in ("huge", "chunk", "last", "first", "stop")}, "n": len(t.ids), "skipped": skipped,
                                "head": _listed(t.cut(0, n)), "tail": _listed(t.cut(skipped, len(t.ids)))})
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return chunks.select("huge", "chunk", "last", "first", "stop", "fixed", "free", "text").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    longs, flags = pa.list_(pa.int64()), pa.list_(pa.bool_())
    tokens = pa.struct([(f, flags if f == "whole" else longs) for f in _FIELDS])
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = schema.replace(_LIST, "tokens").split(", ")
    return pa.schema([(f.split()[0], tokens if f.endswith("tokens") else kinds[f.split()[1]]) for f in fields])


def _splices(encoded: DataFrame, path: str) -> DataFrame:
    """(huge, chunk, delta) of each chunk and its successor: tokens to add to the sum of the last chunks; null if unproven."""
    left = encoded.where("not last").select("huge", "chunk", "stop", "skipped", "tail")
    right = encoded.where("chunk > 0").select("huge", (F.col("chunk") - 1).alias("chunk"), "first", "head")
    schema = "huge long, chunk int, delta long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = guard_of(load(path))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = splice(_told(r["tail"]), _told(r["head"]), r["first"], r["stop"], guard)
                out.append({"huge": r["huge"], "chunk": r["chunk"], "delta": found and r["skipped"] + found[0] - found[1]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return left.join(right, ["huge", "chunk"]).mapInArrow(run, schema)


def _widen(failed: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """The unproven splices again, with longer overlaps."""
    left = chunks.select("huge", "chunk", F.col("text").alias("left"), F.col("first").alias("origin"), "fixed")
    right = chunks.select("huge", (F.col("chunk") - 1).alias("chunk"), F.col("text").alias("right"), "first", "free")
    schema = "huge long, chunk int, delta long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                found = widened(model, r["left"], r["right"], r["first"] - r["origin"], r["fixed"] - r["origin"], r["free"] - r["first"])
                yield pa.RecordBatch.from_pylist([{"huge": r["huge"], "chunk": r["chunk"], "delta": found and found[0] - found[1]}],
                                                 schema=_arrow(schema))

    return failed.select("huge", "chunk").join(left, ["huge", "chunk"]).join(right, ["huge", "chunk"]).mapInArrow(run, schema)


def _whole(chunks: DataFrame, path: str) -> DataFrame:
    """(huge, n) of texts put together from their chunks and encoded at once."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        text = "".join(r["text"][:(after["first"] if after else r["stop"]) - r["first"]] for r, after in zip(rows, [*rows[1:], None]))
        return pa.table({"huge": pa.array([rows[0]["huge"]], pa.int64()), "n": pa.array([len(load(path).ids([text])[0])], pa.int64())})

    return chunks.select("huge", "chunk", "first", "stop", "text").groupBy("huge").applyInArrow(run, "huge long, n long")


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None, limit: int = 2048,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns (default doc_id) with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    A null or empty text has no bytes and no tokens; repeated rows are answered each; other columns are
    ignored. Texts of at most chunk + 2 * overlap code points are counted where they are read. Longer ones
    are cut there and their chunks shuffled, so that one huge text is the work of many tasks; a task
    holds one chunk at a time. Only a text whose chunks agree at no overlap up to a whole chunk (none was met
    but made-up periodic ones) is encoded at once.
    """
    keep = keep or ["doc_id"]
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").alias("text"))
    cut = cut_lineage(_cut(rows, names, path, chunk, overlap), "token-counts")
    chunks = cut.where("chunk is not null").select("huge", "chunk", "last", "first", "stop", "fixed", "free", "text")
    per_text = cut.where("chunk is null")
    if not chunks.isEmpty():
        encoded = cut_lineage(_encode_chunks(chunks.repartition("huge", "chunk"), path), "token-chunks")
        spliced = cut_lineage(_splices(encoded, path), "token-splices")
        failed, whole = spliced.where("delta is null"), None
        if not failed.isEmpty():
            again = cut_lineage(_widen(failed, chunks, path), "token-splices")
            spliced = spliced.where("delta is not null").unionByName(again)
            never = again.where("delta is null").select("huge").distinct()
            whole = _whole(chunks.join(never, "huge", "left_semi"), path)
        parts = encoded.where("last").select("huge", "n").unionByName(spliced.select("huge", F.col("delta").alias("n")))
        if whole is not None:
            parts = parts.join(never, "huge", "left_anti").unionByName(whole)
        totals = parts.groupBy("huge").agg(F.sum("n").alias("total"))
        per_text = per_text.join(totals, "huge", "left").withColumn("n_tokens", F.coalesce("n_tokens", "total"))
    return per_text.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "n_tokens",
                           (F.col("n_tokens") > limit).alias("over_limit"))
