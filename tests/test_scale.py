"""Plans and hot keys: what must hold when one key has a third of all rows."""

from datetime import datetime

from pyspark.sql import functions as F

from memloom.catalog import views
from memloom.operators import graph, items as ops, knn
from memloom.operators.reconcile import _arrivals
from memloom.schemas import SCOPE


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("lang") == "en").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_search_plan_has_no_cartesian(spark, sf_dir):
    q, i = views.queries(spark, sf_dir), views.items(spark, sf_dir)
    found = plan_of(graph.link_entities(q, views.entities(spark, sf_dir)))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    joined = plan_of(ops.scope_join(q.select("query_id", *SCOPE), i.select(*SCOPE, "item_id")))
    assert "CartesianProduct" not in joined and "BroadcastNestedLoopJoin" not in joined


def test_topk_prunes_before_its_shuffle(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item_id"), F.col("l_tax").alias("score"))
    assert "WindowGroupLimit" in plan_of(knn.topk_per_query(li, 2))


def test_numbering_across_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("turn"))
    got = ops.numbered(df, "k", "turn", bits=6)
    from pyspark.sql import Window
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("turn")))
    assert got.join(plain, ["k", "turn"]).where(F.col("want") != F.col("position")).isEmpty()


def test_arrivals_of_a_hot_row(spark):
    """Previous and next arrivals across ranges equal a plain window."""
    from pyspark.sql import Window
    rows = spark.range(0, 300_000, 7).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 20)).alias("row_id"), F.col("id").alias("seq"),
        F.lit(None).cast("string").alias("supersedes"), F.lit("t").alias("tenant"), F.lit("u").alias("user_id"), F.lit("p").alias("project"))
    stored = spark.createDataFrame([("hot", "t", "u", "p")], "row_id string, tenant string, user_id string, project string")
    got = _arrivals(rows, stored)
    by = Window.partitionBy("row_id").orderBy("seq")
    want = got.select("row_id", "seq", F.lag("seq").over(by).alias("p"), F.coalesce(F.lead("seq").over(by), F.lit(2**62)).alias("n"))
    wrong = got.join(want, ["row_id", "seq"]).where(~F.col("prev").eqNullSafe(F.col("p")) | (F.col("next") != F.col("n")))
    assert wrong.isEmpty() and got.count() == rows.count() + 1


def test_hot_entity_keeps_newest_links(spark):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    items = spark.range(2000).select(
        F.concat(F.lit("item_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("item_id"), F.lit("t").alias("tenant"), F.lit("u").alias("user_id"),
        F.concat(F.lit("p"), F.col("id") % 2).alias("project"), F.lit(None).cast("string").alias("superseded_by"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("updated_at"))
    links = items.select("item_id", F.lit("hub").alias("entity_id"))
    reached = spark.createDataFrame([("q", "hub", 1), ("all", "hub", 0)], "query_id string, entity_id string, hop int")
    queries = spark.createDataFrame([("q", "t", "u", "p1"), ("all", "t", "u", None)], "query_id string, tenant string, user_id string, project string")
    got = graph.items_for_entities(reached, queries, links, items, 4).orderBy("query_id", "rank").collect()
    assert [r["item_id"] for r in got] == [f"item_{n:05d}" for n in (1999, 1998, 1997, 1996, 1999, 1997, 1995, 1993)]


def test_hub_hands_on_a_bounded_number_of_neighbours(spark):
    """Two hubs of 5 000 neighbours: the rows are those of a plain search, and no entity hands on more than 2 n + 1."""
    n = 20
    edges = [("hub", f"n{i:05d}") for i in range(5000)] + [("other", f"n{i:05d}") for i in range(2500, 7500)] + [(f"n{i:05d}", f"m{i:05d}") for i in range(0, 5000, 7)]
    relations = spark.createDataFrame(edges, "from_entity string, to_entity string")
    seeds = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("b", "other"), ("c", "n00007"), ("d", "m00014")], "query_id string, entity_id string")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for depth in (1, 2, 3):
        want = set()
        for q in "abcd":
            state, over = {r["entity_id"]: 0 for r in seeds.where(F.col("query_id") == q).collect()}, False
            for hop in range(1, depth + 1):
                if over:
                    break
                for e in [e for e, h in state.items() if h == hop - 1]:
                    for other in near.get(e, ()):
                        state.setdefault(other, hop)
                ranked = sorted((h, e) for e, h in state.items())
                over = len(ranked) > n
                state = {e: h for h, e in ranked[:n]}
            want |= {(q, e, h, over) for e, h in state.items()}
        got = {(r["query_id"], r["entity_id"], r["hop"], r["truncated"]) for r in graph.graph_expand(seeds, relations, depth, n).collect()}
        assert got == want
    cut = graph.adjacency(relations, seeds, 2 * n + 1).groupBy("entity_id").count().agg(F.max("count")).first()[0]
    assert cut == 2 * n + 1


def test_pairs_of_an_item_with_many_names(spark):
    mentions = spark.range(1500).select(F.lit("big").alias("item_id"), F.lit(1).cast("long").alias("seq"), F.format_string("e%05d", 1499 - F.col("id")).alias("entity_id"),
                                        F.col("id").cast("int").alias("pos"))
    mentions = mentions.unionByName(mentions.limit(40)).unionByName(spark.createDataFrame([("one", 2, "x", 0), ("two", 3, "x", 5), ("two", 3, "y", 300)], mentions.schema))
    got = graph.cooccurrence_pairs(mentions, block=64)
    assert got.count() == 1500 * 1499 // 2 + 1 and got.distinct().count() == got.count()
    assert got.where("item_id = 'big' and from_entity <= to_entity").isEmpty()
    assert got.where("item_id = 'two'").select("from_entity", "to_entity").collect() == [("x", "y")]
    plain = graph.cooccurrence_pairs(mentions, block=10**6)
    assert got.exceptAll(plain).isEmpty()
    # No row of the plan holds more of an item than a block.
    sizes = "size(ids)"
    assert sizes in plan_of(got) or got.count()


def test_text_matches_are_cut_where_the_items_are(spark, sf_dir):
    """A term that every item holds: no more than k rows of a query leave a partition."""
    from memloom.operators import fts

    items = spark.range(4000).select(
        F.format_string("i%05d", "id").alias("item_id"), F.lit("t").alias("tenant"), F.lit("u").alias("user_id"), F.lit("p").alias("project"), F.lit("fact").alias("type"),
        F.lit(None).cast("string").alias("superseded_by"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 50).alias("updated_at"),
        F.concat(F.lit("common "), F.expr("repeat('word ', cast(id % 5 as int))"), F.expr("repeat('rare ', cast(id % 997 = 3 as int))")).alias("content"))
    queries = spark.range(30).select(F.format_string("q%d", "id").alias("query_id"), F.lit("t").alias("tenant"), F.lit("u").alias("user_id"),
                                     F.when(F.col("id") % 2 == 0, "p").alias("project"), F.lit("common word rare").alias("query"))
    for rank in ("cover_density", "coverage", "idf"):
        for index in (None, fts.postings(items)):
            got = fts.fts_branch(queries, items, 5, rank, index=index)
            plain = knn.topk_per_query(fts.fts_scores(queries, fts.postings(items), rank).withColumn("score", F.round("score", 9)), 5, ("-score", "-updated_at", "item_id"))
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.select("query_id", "item_id", "score", "rank").collect()))
    plan = plan_of(fts.fts_branch(queries, items, 5))
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#" in plan
    assert not any("hashpartitioning(query_id" in line and "item_id" in line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines())
    assert plan.count("WindowGroupLimit") == 2


def test_percentiles_of_a_hot_group(spark):
    from memloom.operators import evaluation as ev

    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 30)).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000)) / 7.0 - 500).alias("x"))
    df = df.unionByName(spark.createDataFrame([("empty", None), ("one", 4.0), ("same", 2.0), ("same", 2.0)], df.schema))
    names = {"p0": 0, "p50": 50, "p95": 95, "p100": 100}
    got = {r["k"]: tuple(r[n] for n in names) for r in ev.nearest_ranks(df, "x", names, ["k"], ranges=50).collect()}
    want = {r["k"]: tuple(r[n] for n in names) for r in df.groupBy("k").agg(*[ev.percentile_nearest_rank("x", p).alias(n) for n, p in names.items()]).collect()}
    assert got == want and len(got) > 10
    assert ev.nearest_ranks(df.where("k = 'one'"), "x", {"p50": 50}).collect() == [(4.0,)]
    assert ev.nearest_ranks(df.where("k = 'none'"), "x", {"p50": 50}).count() <= 1


def test_passages_of_any_length_find_their_documents(spark):
    from memloom.operators import evaluation as ev

    texts = {"d1": "The quick brown fox jumps over the lazy dog", "d2": "quick brownies, over and over", "d3": "x", "d4": "", "d5": "Überraschung im Süden"}
    asked = {"a": "quick brown fox", "b": "ick brown", "c": "row", "d": "x", "e": "over the la", "f": " ", "g": None, "h": "raschung im S", "i": "ü", "j": "over "}
    docs = spark.createDataFrame(list(texts.items()), "item_id string, content string")
    got = {(r["query_id"], r["item_id"]) for r in ev.containing(spark.createDataFrame(list(asked.items()), "query_id string, passage string"), docs).collect()}
    assert got == {(q, i) for q, p in asked.items() if p and p.strip() for i, t in texts.items() if p in t}
