"""Personal data by pattern, checksum and context, in built-in Spark functions alone.

A regular expression proposes spans, a validator confirms them, and words beside the span move its
score. Matches and the text between them come from two passes of one pattern, so a span's place is a
running sum of lengths; texts that lack what a kind cannot do without are not searched for it.
The patterns take possessive and guarded forms of the contract's, which match the same spans but
neither recurse nor start again inside a run, so a very long run costs linear time. Places are summed in
chunks of hits and contexts cut from short segments of the text, so many hits in a long text cost linear time too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of every listing; the last is the method's own, beyond the base.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban"]

_LOCAL = "[A-Za-z0-9._%+-]"
#: Countries by the characters of their account numbers, without country code and check digits.
_ACCOUNTS = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG",
    21: "AO CV GW LY MZ PT ST", 22: "DZ IR IS TR", 23: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    24: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
_COUNTRY = "|".join("|".join(c.split()) for c in _ACCOUNTS.values())
_ACCOUNT = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}+" for n, c in _ACCOUNTS.items())
PATTERNS = {
    # A start inside a run of local characters can only succeed right after an earlier match.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole chains of digits with single separators; only those of 13 to 19 digits can pass.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # The country gives the length, so what follows is not swallowed; an unlisted one has any, up to where a listed one begins.
    "iban": rf"(?<![A-Za-z0-9])(?:{_ACCOUNT}|(?!{_COUNTRY})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_COUNTRY})[0-9]{{2}}))?+[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
}
#: Cheap conditions that a text with a match of the kind fulfils.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
}
#: Words that raise the score of a kind when they stand near; others that lower it.
NEAR = {
    "email": "mail|write|contact|address", "ip": "ip|host|server|address", "card": "card|visa|pay|credit",
    "phone": "phone|tel|call|mobile", "iban": "iban|bank|account|transfer",
}
AGAINST = "version|isbn|order|serial|example|test"
BEFORE, AFTER = 40, 20
#: Prior score of a confirmed span, and what a word near it adds or takes away.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
STEP = 0.2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum of a string of digits: every second digit from the right counts by its double's digit sum."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(back)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.substring(F.translate(back, "0123456789", "0246813579"), i, F.lit(1)).cast("int")))
    return total % 10 == 0


def mod97_ok(code: Column) -> Column:
    """The international account checksum: first four characters last, letters as 10 to 35, remainder 1 of 97."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, i: (acc * F.when(value(F.substring(turned, i, F.lit(1))) > 9, 100).otherwise(10)
                        + value(F.substring(turned, i, F.lit(1)))) % 97)
    return rest == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return luhn_ok(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return mod97_ok(found)
    return F.lit(True)


_PART = "array<struct<kind:string,start:int,end:int,score:double>>"


#: Hits in a chunk of running sums, and code points in a segment of the text.
CHUNK, SEGMENT = 256, 1024


def _segments(text: Column) -> Column:
    """The text cut every SEGMENT code points, in one pass: a place deep in it is then near the start of a short string."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def _cut(segments: Column, start: Column, length: int) -> Column:
    """`length` code points (at most SEGMENT) from `start` on, as far as the text goes; a start before 0 takes the fewer."""
    first = F.greatest(start, F.lit(0))
    at = F.floor(first / SEGMENT).cast("int")
    near = F.concat(*[F.coalesce(F.try_element_at(segments, at + i), F.lit("")) for i in (1, 2)])
    return F.substring(near, first - at * SEGMENT + 1, length - (first - start))


_HITS = "array<struct<hit:string,start:int>>"


def _placed(between: Column, found: Column) -> Column:
    """(hit, start) of all matches: lengths are summed inside chunks, and the totals of the chunks before are added."""
    pairs = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    summed = lambda chunk: F.aggregate(
        chunk, F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("list")),
        lambda acc, x: F.struct(
            (acc["at"] + length(x)).alias("at"),
            F.when(x["hit"].isNull(), acc["list"]).otherwise(F.array_append(
                acc["list"], F.struct(x["hit"].alias("hit"), (acc["at"] + F.length(x["gap"])).alias("start")))).alias("list")))
    chunks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK)), lambda i: summed(F.slice(pairs, i, CHUNK)))
    moved = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HITS}>").alias("lists")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["lists"], F.transform(
            c["list"], lambda h: F.struct(h["hit"].alias("hit"), (h["start"] + acc["at"]).alias("start")))).alias("lists")))
    return F.flatten(moved["lists"])


def _spans(text: Column, segments: Column, kind: str) -> Column:
    """Confirmed spans of one kind, by start; null where the kind cannot occur."""
    placed = _placed(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
    kept = F.filter(placed, lambda s: _valid(kind, s["hit"]))

    def scored(s: Column) -> Column:
        end = s["start"] + F.length(s["hit"])
        around = F.lower(F.concat(_cut(segments, s["start"] - BEFORE, BEFORE), F.lit(" "), _cut(segments, end, AFTER)))
        score = F.lit(PRIOR[kind]) + F.when(around.rlike(rf"\b({NEAR[kind]})"), STEP).otherwise(0.0) \
            - F.when(around.rlike(rf"\b({AGAINST})"), STEP).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), end.alias("end"),
                        F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    return F.when(NEEDS[kind](text), F.transform(kept, scored))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and `pii`: an array of (kind, start, end, score) in order of kind as listed, then start.

    Positions count code points, ends are exclusive. Kinds are searched apart, so spans of two kinds
    may overlap. A null or empty text has an empty array; repeated rows are answered each.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = rows.withColumn("_segments", _segments(F.col("text")))
    parts = cut.select("doc_id", "text", *[_spans(F.col("text"), F.col("_segments"), k).cast(_PART).alias(f"_{k}") for k in KINDS])
    empty = F.array().cast(_PART)
    return parts.select("doc_id", "text", F.concat(*[F.coalesce(F.col(f"_{k}"), empty) for k in KINDS]).alias("pii"))


def redact(found: DataFrame, floor: float = 0.0) -> DataFrame:
    """find_pii's rows with spans scored at least `floor` replaced by [kind], in `redacted`."""
    chosen = F.array_sort(F.filter("pii", lambda s: s["score"] >= floor), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    built = F.aggregate(
        chosen, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("redacted", built)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("pii")).alias("spans"))
