"""Text renderings and small classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_CLASS

MEMORY_TOOL = r"^mcp__memory__"
ANY_MEMORY_TOOL = r"^mcp__[A-Za-z0-9_-]*memory[A-Za-z0-9_-]*__"

# Beginnings of reports that summarize_tool_text reads back, and what it makes of them.
FOUND, NOTHING_FOUND, STORED, KNOWN = "%d item(s) matched", "No memory matched", "Stored as", "Already known"
SHORT_FORMS = {NOTHING_FOUND: "no memories matched", STORED: "stored a new memory", KNOWN: "already knew this"}
PLAIN_CHARS, LINE_CHARS, TITLE_CHARS = 200, 120, 60

# Commit trailers that carry no reasoning.
TRAILERS = ["Co-Authored-By", "Signed-off-by", "Claude-Session", "Reviewed-by"]

# Prose that argues for a choice (English, Vietnamese).
DECISION_LANGUAGE = "|".join([
    "we (chose|picked|decided|settled|went with|use|prefer)",
    "(instead of|rather than|as opposed to)",
    "(because|the reason|which is why|on purpose|deliberately|by design)",
    "(trade[- ]?off|we rejected|we considered|not worth)",
    "(quy[eế]t đ[iị]nh|l[yý] do|thay v[iì]|b[oở]i v[iì]|ch[uọ]n)",
])

# Error codes worth a retry.
RETRYABLE = ["timeout", "overloaded", "upstream_failed"]


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^A-Za-z0-9_]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 60)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def strip_trailers(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"(?im)^({'|'.join(TRAILERS)}):.*$", ""))


def argues(c: Column) -> Column:
    return c.rlike(f"(?iu){DECISION_LANGUAGE}")


def promote_decision(base: Column, body: Column) -> Column:
    """An artifact section that argues for a choice is a decision."""
    return F.when((base == "artifact") & argues(body), "decision").otherwise(base)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def item_label(item_id: Column, type_: Column, created_at: Column, source: Column) -> Column:
    return F.concat(
        F.lit("["), item_id, F.lit("] ("), type_, F.lit(", "), day(created_at),
        F.lit(", src="), source, F.lit(")"),
    )


def human_size(n: Column) -> Column:
    kib, mib = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / kib))
        .otherwise(F.format_string("%.1f MB", n / mib))
    )


def retryable(code: Column) -> Column:
    return code.isin(RETRYABLE)


def is_memory_tool(name: Column, wide: bool = False) -> Column:
    return name.rlike(ANY_MEMORY_TOOL if wide else MEMORY_TOOL)


def summarize_tool_text(name: Column, text: Column) -> Column:
    """A short human line for a tool's output."""
    matched = F.regexp_extract(text, r"(?m)^(\d+) item\(s\) matched", 1)
    return (
        F.when(js_trim(text) == "", "done")
        .when(~is_memory_tool(name), F.left(text, F.lit(PLAIN_CHARS)))
        .when(matched != "", F.concat(F.lit("found "), matched, F.lit(" memories")))
        .when(text.startswith(NOTHING_FOUND), SHORT_FORMS[NOTHING_FOUND])
        .when(text.startswith(STORED), SHORT_FORMS[STORED])
        .when(text.startswith(KNOWN), SHORT_FORMS[KNOWN])
        .otherwise(F.left(F.element_at(F.split(text, "\n", -1), 1), F.lit(LINE_CHARS)))
    )


def derive_title(message: Column) -> Column:
    """First-line title of at most 60 characters."""
    line = js_trim(F.regexp_replace(message, f"[{SPACE_CLASS}]+", " "))
    return F.when(F.length(line) <= TITLE_CHARS, line).otherwise(
        F.concat(F.left(line, F.lit(TITLE_CHARS - 3)), F.lit("…"))
    )


def write_error(type_: Column, content: Column, source: Column) -> Column:
    """Why a write is refused before it reaches the privacy filter, or null."""
    from memloom.schemas import MEMORY_TYPES

    return (
        F.when(type_.isNull() | ~type_.isin(MEMORY_TYPES), "bad type")
        .when(content.isNull() | (js_trim(content) == ""), "content is required")
        .when(source.isNull() | (source == ""), "source is required")
    )


CITATION_BLOCK = (
    r"(?m)^\[(item_[a-z0-9]+)\]\s*\((\w+),\s*([\d-]+),\s*src=([^\n]*)\)$"
    r"((?:\n(?!\[)(?=[^\n]*[^\s])[^\n]*)*)"
)


def parse_citations(text: Column) -> Column:
    """array<struct(item_id, type, day, source, snippet)> read back from a packed block."""
    blocks = F.regexp_extract_all(text, F.lit(CITATION_BLOCK), F.lit(0))
    part = lambda b, g: F.regexp_extract(b, CITATION_BLOCK, g)
    return F.transform(
        blocks,
        lambda b: F.struct(
            part(b, 1).alias("item_id"),
            part(b, 2).alias("type"),
            part(b, 3).alias("day"),
            part(b, 4).alias("source"),
            F.left(
                F.regexp_replace(F.regexp_replace(part(b, 5), "^\n", ""), "\n", " "), F.lit(300)
            ).alias("snippet"),
        ),
    )
