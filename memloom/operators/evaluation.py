"""Retrieval quality over golden queries.

relevant(query_id, item_id) and retrieved(query_id, item_id, rank); queries(query_id[, latency_ms]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(queries: DataFrame, relevant: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per query: number relevant, and the sorted ranks at which relevant items came."""
    wanted = relevant.select("query_id", "item_id").distinct()
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = wanted.join(retrieved.select("query_id", "item_id", "rank"), ["query_id", "item_id"])
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("rank").cast("int"))).alias("hit_ranks"))
    return (
        queries.join(counts, "query_id", "left").join(found, "query_id", "left")
        .withColumns({
            "n_relevant": F.coalesce("n_relevant", F.lit(0)),
            "hit_ranks": F.coalesce("hit_ranks", F.array().cast("array<int>")),
        })
    )


def _in_top(k: int) -> Column:
    return F.filter("hit_ranks", lambda r: r <= k)


def recall_at(k: int) -> Column:
    return F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.size(_in_top(k)) / F.col("n_relevant"))


def mrr_at(k: int) -> Column:
    return F.coalesce(1.0 / F.array_min(_in_top(k)), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    n = F.least(F.lit(k), F.col("n_relevant")).cast("int")
    ideal = gain(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return F.when(n == 0, 1.0).otherwise(gain(_in_top(k)) / ideal)


def query_metrics(judgements: DataFrame) -> DataFrame:
    return judgements.withColumns({
        "recall_at_5": recall_at(5), "recall_at_10": recall_at(10),
        "mrr_at_10": mrr_at(10), "ndcg_at_10": ndcg_at(10),
    })


def mean_or_zero(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def percentile_nearest_rank(column: str, p: float) -> Column:
    """The smallest value with at least p per cent of the values at or below it; never interpolates.

    As an aggregate it holds a group's distinct values in one buffer; `nearest_ranks` does not.
    """
    return F.coalesce(F.expr(f"percentile_disc({p / 100.0}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0))


def nearest_ranks(df: DataFrame, column: str, percents: dict[str, float], by: list[str] | None = None, ranges: int = 1000) -> DataFrame:
    """(by, one column for each percentile): the smallest value with at least p per cent of the values at or below it.

    Equal values are counted by a combined aggregate. Sketched bounds cut each group's values into about
    `ranges` ranges, whose exact totals tell which range holds a rank; only that range is ordered. The bounds
    change which range it is and never the value. A group without values has 0.0.
    """
    by = by or []
    # As fields of a struct, null keys equal each other and join.
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_one"))
    values = df.select(group.alias("g"), F.col(column).cast("double").alias("x"))
    marks = values.groupBy("g").agg(
        F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"), F.count("x").alias("n"))
    counted = values.where(F.col("x").isNotNull()).groupBy("g", "x").agg(F.count("*").alias("c"))
    # How many bounds lie below the value: a binary search over a sorted list of fixed length.
    placed = counted.join(marks.select("g", "bounds"), "g").select("g", "x", "c", _range_of(F.col("x"), F.col("bounds"), ranges).alias("r"))
    totals = placed.groupBy("g", "r").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("g").orderBy("r")
    # At most `ranges` rows a group.
    runs = totals.withColumn("upto", F.sum("c").over(upto)).withColumn("before", F.col("upto") - F.col("c")).select("g", "r", "before", "upto")
    asked = marks.select("g", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p / 100.0).alias("p")) for name, p in percents.items()])).alias("q"))
    ranks = asked.where(F.col("n") > 0).select("g", "q.name", F.greatest(F.lit(1), F.ceil(F.col("q.p") * F.col("n"))).alias("rank"))
    hit = ranks.join(runs, "g").where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    inside = placed.join(hit.select("g", "r", "before").distinct(), ["g", "r"])
    order = Window.partitionBy("g", "r").orderBy("x")
    ordered = inside.withColumn("upto", F.col("before") + F.sum("c").over(order)).select("g", "r", "x", "upto")
    found = hit.select("g", "r", "name", "rank").join(ordered, ["g", "r"]).where(F.col("upto") >= F.col("rank")).groupBy("g", "name").agg(F.min("x").alias("x"))
    told = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("m"))
    return marks.select("g").join(told, "g", "left").select(
        *[F.col(f"g.{c}").alias(c) for c in by], *[F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(0.0)).alias(name) for name in percents])


def _range_of(x: Column, bounds: Column, ranges: int) -> Column:
    """The number of bounds below x, by halving: bounds ascend."""
    steps = [1 << i for i in reversed(range(ranges.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(bounds)) & (F.try_element_at(bounds, at + step) < x), at + step).otherwise(at))


def eval_report(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of means, latency percentiles and misses, or one per group."""
    miss = F.sum(F.when(F.col("recall_at_10") == 0, 1).otherwise(0))
    means = metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"),
        mean_or_zero("recall_at_5").alias("recall_at_5"), mean_or_zero("recall_at_10").alias("recall_at_10"),
        mean_or_zero("mrr_at_10").alias("mrr_at_10"), mean_or_zero("ndcg_at_10").alias("ndcg_at_10"),
        F.coalesce(miss, F.lit(0)).alias("misses"),
    )
    ranks = nearest_ranks(metrics, "latency_ms", {"latency_p50": 50, "latency_p95": 95}, by)
    told = ranks.select(*[F.col(c).alias(f"_{c}") for c in by or []], "latency_p50", "latency_p95", F.lit(0).alias("_one"))
    same = F.lit(0) == F.col("_one")
    for c in by or []:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = means.withColumn("_zero", F.lit(0)).join(told, same if by else F.col("_zero") == F.col("_one"), "left")
    return joined.select(
        *(by or []), "queries", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10",
        F.coalesce("latency_p50", F.lit(0.0)).alias("latency_p50"), F.coalesce("latency_p95", F.lit(0.0)).alias("latency_p95"), "misses")


def eval_misses(queries: DataFrame, relevant: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Queries with nothing relevant retrieved: what was wanted and the first three that came."""
    hit = relevant.join(retrieved, ["query_id", "item_id"], "left_semi").select("query_id").distinct()
    missed = queries.join(hit, "query_id", "left_anti")
    wanted = relevant.groupBy("query_id").agg(F.array_sort(F.collect_list("item_id")).alias("wanted"))
    top = retrieved.where(F.col("rank") <= 3).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda r: r["item_id"]).alias("got")
    )
    return missed.join(wanted, "query_id", "left").join(top, "query_id", "left")


def eval_gate(report: DataFrame, min_recall: float = 0.0, max_p95: float = 0.0) -> DataFrame:
    """Reasons to fail; a threshold of zero is off."""
    low = F.when(F.lit(min_recall > 0) & (F.col("recall_at_10") < min_recall), "recall@10 below minimum")
    slow = F.when(F.lit(max_p95 > 0) & (F.col("latency_p95") > max_p95), "p95 above maximum")
    reasons = F.filter(F.array(low, slow), lambda r: r.isNotNull())
    return report.withColumn("failures", reasons).withColumn("passed", F.size(F.col("failures")) == 0)


def format_report(label: Column) -> Column:
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    number = lambda c: F.format_string("%.3f", F.col(c))
    return F.concat_ws(
        "\n", label,
        F.concat(F.lit("  queries      "), F.col("queries").cast("string")),
        F.concat(F.lit("  recall@5     "), percent("recall_at_5")),
        F.concat(F.lit("  recall@10    "), percent("recall_at_10")),
        F.concat(F.lit("  MRR@10       "), number("mrr_at_10")),
        F.concat(F.lit("  nDCG@10      "), number("ndcg_at_10")),
        F.concat(F.lit("  latency p50  "), F.format_string("%.0fms", "latency_p50")),
        F.concat(F.lit("  latency p95  "), F.format_string("%.0fms", "latency_p95")),
        F.concat(F.lit("  total miss   "), F.col("misses").cast("string")),
    )


def resolve_refs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted(query_id, ref) to stored(ref, item_id); an unknown ref fails the job."""
    joined = wanted.join(stored, "ref", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown corpus ref "), F.col("ref"))).cast("string")
    return joined.withColumn("item_id", F.coalesce("item_id", unknown))


_WINDOW = 3


def containing(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, item_id) of every doc(item_id, content) that contains a passage(query_id, passage).

    Between blanks a passage has words; the inner ones are whole words of the document too, and the longest
    of them finds the documents to look into. A passage without inner words may begin and end inside words: the first
    three characters of its longest piece are met among the windows of the documents' words. Containment itself
    is checked after the join. A null passage, or one of blanks only, asks for nothing.
    """
    pieces = F.filter(F.split("passage", r"\s+"), lambda w: w != "")
    longest = lambda words: F.try_element_at(F.array_sort(words, lambda x, y: F.length(y) - F.length(x)), F.lit(1))
    told = passages.select("query_id", "passage", pieces.alias("pieces")).where(F.size("pieces") > 0)
    # A blank at an end makes the word there whole, but it stays a piece like any other.
    inner = told.withColumn("word", longest(F.slice("pieces", 2, F.greatest(F.size("pieces") - 2, F.lit(0)))))
    words = docs.select("item_id", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("word")).where(F.col("word") != "")
    found = inner.where(F.col("word").isNotNull()).select("query_id", "passage", "word").join(words, "word").select("query_id", "passage", "item_id")
    short = inner.where(F.col("word").isNull()).select("query_id", "passage", F.left(longest(F.col("pieces")), F.lit(_WINDOW)).alias("gram"))
    if not short.isEmpty():
        windows = F.flatten(F.array(*[F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - (n - 1))), lambda i: F.substring(F.col("word"), i, F.lit(n)))
            for n in range(1, _WINDOW + 1)]))
        near = words.select("item_id", F.explode(F.array_distinct(windows)).alias("gram")).join(
            short.select("gram").distinct(), "gram", "left_semi").distinct()
        found = found.unionByName(near.join(short, "gram").select("query_id", "passage", "item_id"))
    return found.distinct().join(docs.select("item_id", "content"), "item_id").where(
        F.contains("content", "passage")).select("query_id", "item_id")
