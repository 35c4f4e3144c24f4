"""Cheap token estimates that never under-count, and truncation to a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_CLASS, is_ascii

CHARS_PER_TOKEN = 3.4
# Fixed ranges: characters counted as one token each.
WIDE = r"\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}"


def _cost(wide: Column, total: Column) -> Column:
    return F.ceil(wide + (total - wide) / F.lit(CHARS_PER_TOKEN))


def wide_chars(c: Column) -> Column:
    return F.when(is_ascii(c), F.lit(0)).otherwise(
        F.length(F.regexp_replace(c, f"[^{WIDE}]+", ""))
    )


def estimate_tokens(c: Column) -> Column:
    return _cost(wide_chars(c), F.length(c)).cast("long")


def _fitting_prefix(c: Column, budget: Column) -> Column:
    """Length of the longest prefix whose estimate is within budget."""
    guess = F.floor(budget * F.lit(CHARS_PER_TOKEN)).cast("int")
    fits = lambda n: F.ceil(n / F.lit(CHARS_PER_TOKEN)) <= budget
    narrow = F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)
    head = F.substring(c, F.lit(1), guess + 1)
    step = lambda acc, ch: F.when(
        acc["open"]
        & (_cost(acc["wide"] + ch.rlike(f"[{WIDE}]").cast("int"), acc["n"] + 1) <= budget),
        F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["wide"] + ch.rlike(f"[{WIDE}]").cast("int")).alias("wide"),
            F.lit(True).alias("open"),
        ),
    ).otherwise(F.struct(acc["n"].alias("n"), acc["wide"].alias("wide"), F.lit(False).alias("open")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("wide"), F.lit(True).alias("open"))
    mixed = F.aggregate(F.split(head, ""), start, step, lambda acc: acc["n"])
    return F.when(wide_chars(head) == 0, F.least(narrow, F.length(c))).otherwise(mixed)


def truncate_to_tokens(c: Column, budget: Column) -> Column:
    """Longest prefix that fits, cut back to a word boundary when one lies beyond 60 %."""
    n = _fitting_prefix(c, budget)
    cut = F.substring(c, F.lit(1), n)
    from_end = F.position(F.lit(" "), F.reverse(cut))
    space = F.when(from_end > 0, F.length(cut) - from_end).otherwise(-1)
    chosen = F.when(space > n * F.lit(0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    trimmed = F.regexp_replace(chosen, f"[{SPACE_CLASS}]+$", "")
    return (
        F.when(budget <= 0, "")
        .when(estimate_tokens(c) <= budget, c)
        .otherwise(trimmed)
    )
