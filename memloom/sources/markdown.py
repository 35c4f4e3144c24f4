"""Markdown files of any size as sections, by an associative scan over ranges of lines.

What a range does to the state at its start is summed up for each fence that may be open there: the fence
at its end, the number of headings, the level from which on the heading stack is cleared, and the headings pushed on it.
Such summaries compose, so every range of a file learns the state it starts in from one small row per
range, and all ranges are then read in parallel. Sections that span ranges are joined by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.items import numbered
from memloom.session import cut_lineage

RANGE_CHARS = 1 << 20
#: Deeper than any heading: nothing of the stack is cleared.
_NONE = 7
FENCES = ("", "`", "~")

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*$")
_CLOSING = re.compile(r"\s*#+\s*$")
_BREAK = re.compile(r"\r?\n")

Stack = list[tuple[int, str]]


def _lines(lines: Iterable[str], fence: str) -> Iterator[tuple[str, str, tuple[int, str] | None]]:
    """(line, fence after it, (level, title) of a heading) line by line; headings inside fences do not count."""
    for line in lines:
        mark = _FENCE.match(line)
        heading = None if mark or fence else _HEADING.match(line)
        if mark:
            sign = mark.group(1)[0]
            fence = sign if not fence else "" if fence == sign else fence
        yield line, fence, heading and (len(heading.group(1)), _CLOSING.sub("", heading.group(2)))


def pushed(stack: Stack, level: int, title: str) -> Stack:
    """The stack after a heading: what is not above it goes."""
    return [entry for entry in stack if entry[0] < level] + [(level, title)]


def breadcrumb(stack: Stack) -> str:
    return " > ".join(title for _, title in stack if title)


def summary(text: str) -> list[tuple[str, int, int, Stack]]:
    """For each fence that may be open at the start: (fence at the end, headings, least level, headings left on the stack)."""
    # Most lines neither open a fence nor hold a heading.
    lines = [line for line in _BREAK.split(text) if line.lstrip()[:1] in ("#", "`", "~")]
    out = []
    for fence in FENCES:
        count, least, stack = 0, _NONE, []
        for _, fence, heading in _lines(lines, fence):
            if heading:
                count, least, stack = count + 1, min(least, heading[0]), pushed(stack, *heading)
        out.append((fence, count, least, stack))
    return out


def sections(text: str, fence: str = "", number: int = 0, stack: Stack = ()) -> Iterator[tuple[int, str | None, list[str]]]:
    """(number, breadcrumb, lines) of the sections of a range; the first one goes on from the range before and has no breadcrumb."""
    crumb, body, stack = None, [], list(stack)
    for line, _, heading in _lines(_BREAK.split(text), fence):
        if heading is None:
            body.append(line)
            continue
        yield number, crumb, body
        stack = pushed(stack, *heading)
        number, crumb, body = number + 1, breadcrumb(stack), []
    yield number, crumb, body


def cut_lines(text: str, size: int = RANGE_CHARS) -> Iterator[tuple[int, str]]:
    """(first character, range) of a text cut behind line breaks into ranges of about `size` characters."""
    start = 0
    while True:
        end = text.find("\n", start + size)
        if end < 0:
            yield start, text[start:]
            return
        yield start, text[start:end].removesuffix("\r") if end > start else ""
        start = end + 1


def split_whole(text: str) -> Iterator[tuple[str, str]]:
    """(breadcrumb, body) of a whole text."""
    for _, crumb, body in sections(text):
        yield crumb or "", "\n".join(body).strip()


# --- the scan ------------------------------------------------------------------------------------

_RANGE = "file string, path string, start long, text string"
_SUMMARY = "file string, start long, fences array<struct<fence: string, headings: long, least: int, stack: array<struct<level: int, title: string>>>>"
_ENTRY = "file string, start long, fence string, headings long, stack array<struct<level: int, title: string>>"
_PIECE = "file string, path string, start long, section long, breadcrumb string, body string"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        told = [[{"fence": f, "headings": n, "least": least, "stack": [{"level": a, "title": t} for a, t in stack]} for f, n, least, stack in summary(text)]
                for text in batch["text"]]
        yield pd.DataFrame({"file": batch["file"], "start": batch["start"], "fences": told})


def _entries(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of every range of one file: a running composition of one small row per range."""
    rows, fence, count, stack = [], "", 0, []
    for file, start, fences in ranges.sort_values("start")[["file", "start", "fences"]].itertuples(index=False):
        rows.append((file, start, fence, count, [{"level": a, "title": t} for a, t in stack]))
        told = fences[FENCES.index(fence)]
        stack = [e for e in stack if e[0] < told["least"]] + [(e["level"], e["title"]) for e in told["stack"]]
        fence, count = told["fence"], count + told["headings"]
    return pd.DataFrame(rows, columns=["file", "start", "fence", "headings", "stack"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            stack = [(e["level"], e["title"]) for e in r.stack]
            rows = [(r.file, r.path, r.start, n, crumb, "\n".join(body) if body else None)
                    for n, crumb, body in sections(r.text, r.fence, r.headings, stack)]
            yield pd.DataFrame(rows, columns=["file", "path", "start", "section", "breadcrumb", "body"])


def _stripped(texts: Column) -> Column:
    """White space off both ends, in the sense of `split_whole`."""

    @F.pandas_udf("string")
    def run(some: pd.Series) -> pd.Series:
        return some.map(str.strip)

    return run(texts)


def section_pieces(ranges: DataFrame) -> DataFrame:
    """(file, path, start, section, breadcrumb, body) of every part of a section that lies in one range."""
    entry = ranges.select("file", "start", "text").mapInPandas(_summaries, _SUMMARY).groupBy("file").applyInPandas(_entries, _ENTRY)
    return ranges.join(entry, ["file", "start"]).select("file", "path", "start", "text", "fence", "headings", "stack").mapInPandas(_pieces, _PIECE)


def sections_of_ranges(ranges: DataFrame) -> DataFrame:
    """(path, pos, breadcrumb, body) of the non-empty sections of ranges(file, path, start, text) that follow each other by start."""
    part = F.struct("start", "body")
    whole = section_pieces(ranges).groupBy("file", "path", "section").agg(
        F.coalesce(F.max("breadcrumb"), F.lit("")).alias("breadcrumb"),
        F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), part))).alias("parts"))
    bodies = whole.withColumn("body", _stripped(F.array_join(F.transform("parts", lambda p: p["body"]), "\n"))).where(F.col("body") != "")
    return numbered(bodies, "file", "section").select("path", (F.col("position") - 1).cast("int").alias("pos"), "breadcrumb", "body")


def ranges_of_texts(docs: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """Ranges of files(path, content), written once; files of one path stay apart."""
    schema = pa.schema([("file", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                number += 1
                for start, text in cut_lines(content.as_py() or "", size):
                    yield pa.RecordBatch.from_pylist([{"file": f"{task}-{number}", "path": path, "start": start, "text": text}], schema=schema)

    return cut_lineage(docs.select("path", "content").mapInArrow(run, _RANGE), "line-ranges")


def read_ranges(spark: SparkSession, root: str, size: int = RANGE_CHARS) -> DataFrame:
    """Ranges of the markdown files below root, read as lines: a file of many splits is read by many tasks and is never one row."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx,MD,MDX,Md,Mdx}").option("lineSep", "\n").text(root)
    placed = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    schema = pa.schema([("file", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, origin, start, chars = [], None, 0, 0

        def flush() -> pa.RecordBatch:
            row = {"file": origin[0], "path": origin[0], "start": start, "text": "\n".join(held)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for value, path, block in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (origin != (path, block) or chars > size):
                    yield flush()
                    # Behind the split's own start, so ranges of one file follow each other by it.
                    start, held = start + chars, []
                    chars = 0
                if origin != (path, block):
                    origin, start = (path, block), block
                line = value.removesuffix("\r")
                held.append(line)
                chars += len(value.encode()) + 1
        if held:
            yield flush()

    return cut_lineage(placed.mapInArrow(run, _RANGE), "line-ranges")


def heading_stack(ranges: DataFrame) -> DataFrame:
    """(path, section, breadcrumb): the heading stack as of each section that a heading starts."""
    return section_pieces(ranges).where(F.col("breadcrumb").isNotNull()).select("path", "section", "breadcrumb")
