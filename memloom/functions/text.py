"""Text normalisation, tokens, overlap and snippets as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words ignored by the tokenizer (English, then accent-free Vietnamese).
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been",
    "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "it", "this",
    "that", "these", "those", "i", "you", "we", "they", "what", "which", "how",
    "do", "does", "did", "can", "will", "would", "should",
    "la", "cua", "va", "co", "khong", "duoc", "cho", "nao", "gi", "nay",
    "mot", "cac", "nhung", "trong", "voi", "thi", "ra", "ve", "tai", "minh",
]

# White space as web-platform regexes define it; Java's \s is ASCII only.
SPACE_CLASS = (
    r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)



@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str]:
    """Precomposed characters, the base of each, and those that also keep a non-letter mark."""
    source, target, with_mark = [], [], []
    for code in range(0xC0, 0x30000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        full = unicodedata.normalize("NFD", char)
        kept = "".join(c for c in full if not 0x300 <= ord(c) <= 0x36F)
        if kept == char or not kept:
            continue
        if len(kept) == 1:
            source.append(char)
            target.append(kept)
        elif code < 0x10000 and all(unicodedata.category(c)[0] not in "LN" for c in kept[1:]):
            source.append(char)
            target.append(kept[0])
            with_mark.append(char)
    return "".join(source), "".join(target), "".join(with_mark)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def normalize_text(c: Column) -> Column:
    """Accent-free, lower case, runs of anything but letters and digits become one space."""
    source, target, with_mark = _decompositions()
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    # A class of many single characters is slow to match, so a range test comes first.
    candidates = rf"[\x{{{ord(min(with_mark)):x}}}-\x{{{ord(max(with_mark)):x}}}]"
    marked = F.when(c.rlike(candidates), F.regexp_replace(c, f"([{with_mark}])", "$1 ")).otherwise(c)
    based = F.translate(marked, source, target)
    folded = F.lower(F.regexp_replace(based, r"[\x{300}-\x{36f}]", ""))
    wide = F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.when(is_ascii(c), plain).otherwise(wide))


def _is_token(word: Column) -> Column:
    syllable = word.rlike(r"^[\x{ac00}-\x{d7a3}]$")
    return ((F.length(word) > 1) | syllable) & ~word.isin(STOPWORDS)


def tokens_of_normalized(n: Column) -> Column:
    return F.filter(F.split(n, " "), _is_token)


def tokenize(c: Column) -> Column:
    return tokens_of_normalized(normalize_text(c))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; zero when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union
    )


def query_terms(tokens: Column, limit: int | None = None) -> Column:
    """All tokens of a query, or its first `limit`."""
    return tokens if limit is None else F.slice(tokens, 1, limit)


def flatten_space(c: Column) -> Column:
    """Every run of white space becomes one space. Lone plain spaces are left without a match."""
    plain, wide = r"\t\n\x0b\f\r", SPACE_CLASS.replace(" ", "", 1)
    runs = lambda odd: f" [ {odd}]+|[{odd}][ {odd}]*"
    return F.trim(F.when(is_ascii(c), F.regexp_replace(c, runs(plain), " ")).otherwise(
        F.regexp_replace(c, runs(wide), " ")))


def first_position(haystack: Column, needles: Column) -> Column:
    """Zero-based place of the earliest needle, or null. The haystack is evaluated once."""
    start = F.struct(haystack.alias("h"), F.lit(None).cast("int").alias("p"))
    step = lambda acc, n: F.struct(
        acc["h"].alias("h"),
        F.least(acc["p"], F.nullif(F.position(n, acc["h"]), F.lit(0))).alias("p"),
    )
    return F.aggregate(needles, start, step, lambda acc: acc["p"] - 1)


def snippet_of(flat: Column, haystack: Column, needles: Column, max_chars: int) -> Column:
    """Snippet from prepared columns: flattened text, its normal form, query tokens."""

    def cut(s: Column) -> Column:
        text, at, size = s["t"], s["at"], F.length(s["t"])
        start = F.greatest(F.lit(0), at - max_chars // 3)
        end = F.least(size, start + max_chars)
        centred = F.concat(
            F.when(start > 0, "…").otherwise(""),
            F.trim(F.substring(text, start + 1, end - start)),
            F.when(end < size, "…").otherwise(""),
        )
        return (
            F.when(size <= max_chars, text)
            .when(at.isNull(), F.concat(F.left(text, F.lit(max_chars - 1)), F.lit("…")))
            .otherwise(centred)
        )

    short = F.length(flat) <= max_chars
    at = F.when(~short, first_position(haystack, needles))
    # A one-element transform binds both values, so that neither is computed again.
    return F.element_at(F.transform(F.array(F.struct(flat.alias("t"), at.alias("at"))), cut), 1)


def snippet(content: Column, query: Column, max_chars: int = 240) -> Column:
    """One line of at most max_chars, centred on the earliest query token found."""
    flat = flatten_space(content)
    return snippet_of(flat, normalize_text(flat), tokenize(query), max_chars)


def with_snippet(df: DataFrame, content: str, query: str, out: str = "snippet", max_chars: int = 240) -> DataFrame:
    """The same as a column of df, with the flattened text computed once per row."""
    staged = df.withColumn("_flat", flatten_space(F.col(content)))
    flat = F.col("_flat")
    hay = F.when(F.length(flat) > max_chars, normalize_text(flat))
    return staged.withColumn(out, snippet_of(flat, hay, tokenize(F.col(query)), max_chars)).drop("_flat")
