"""Cases of the reviewers' findings, each against a plain replay."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from memloom.operators import best, embed, fts, knn


def _words_of_one_bucket(signs, dims=embed.EMBEDDING_DIMS):
    """Words that share a bucket and have the given signs."""
    found = {}
    for i in range(1 << 20):
        word = f"w{i}"
        digest = hashlib.sha256(word.encode()).digest()
        key = int.from_bytes(digest[:4], "big") % dims
        found.setdefault(key, {1: [], -1: []})[-1 if digest[4] & 1 else 1].append(word)
        if all(len(found[key][s]) >= signs.count(s) for s in (1, -1)):
            return key, [found[key][s].pop() for s in signs]


def test_cancelling_counts_leave_what_the_c_logarithm_leaves(spark):
    counts, signs = (1, 2, 3, 6), (-1, 1, 1, -1)
    bucket, words = _words_of_one_bucket(list(signs))
    want = 0.0
    for n, s in zip(counts, signs):
        want += s * (1.0 + math.log(n))
    text = " ".join(" ".join([w] * n) for w, n in zip(words, counts))
    docs = spark.createDataFrame([(1, text + " other")], "id long, text string")
    sparse = {r.bucket: r.w for r in embed.sparse_embedding(docs, "text", "id").collect()}
    dense = embed.hash_embedder("text")(docs).first().embedding
    assert want != 0 and math.isclose(sparse[bucket], want, rel_tol=1e-9) and math.isclose(dense[bucket], want, rel_tol=1e-6)
    assert {i for i, w in enumerate(dense) if w} == set(sparse)


def test_vectors_do_not_depend_on_stretches(monkeypatch):
    import pyarrow as pa

    rows = [["b", "a", "b"], [], ["c"] * 9, ["a", "c"], []]
    lists = pa.array(rows, pa.list_(pa.string()))
    whole = embed._unit_vectors(lists, 16)
    assert list(embed._slices(lists.value_lengths().to_numpy(), rows=2, tokens=4)) == [(0, 2), (2, 1), (3, 2)]
    parts = [embed._unit_vectors(lists.slice(s, n), 16) for s, n in embed._slices(lists.value_lengths().to_numpy(), rows=2, tokens=4)]
    assert [v.tolist() for p in parts for v in p] == whole.tolist()


def test_text_whose_tokens_cancel_counts_as_embedded(spark, tmp_path, monkeypatch):
    from memloom.catalog import functions_catalog, views

    _, (plus, minus) = _words_of_one_bucket([1, -1])
    held = spark.createDataFrame([("a", f"{plus} {minus}"), ("b", "the of"), ("c", ""), ("d", None), ("e", plus)], "item_id string, content string")
    stored = embed.hash_embedder("content")(held)
    assert not any(stored.where("item_id = 'a'").first().embedding)
    monkeypatch.setattr(views, "embedded", lambda s, d: stored)
    assert {r.item_id for r in functions_catalog.embedded_filter(spark, "").collect()} == {"a", "e"}


def test_alert_seq_is_the_least_seq_from_the_alert_on(spark):
    from memloom.streaming.spend import least_seq_from, spend_alerts

    # seq does not follow time: copies of a turn carry other numbers.
    rows = [("c", s, f"2024-01-01 00:00:{t:02d}", 0.4) for s, t in ((9, 1), (8, 2), (7, 3), (2, 4), (5, 5))] + [("d", 1, "2024-01-01 00:00:00", 0.1)]
    usage = spark.createDataFrame(rows, "conversation_id string, seq long, ts string, cost_usd double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = least_seq_from(spend_alerts(usage, 1.0), usage).collect()
    assert [(r.conversation_id, r.alert_seq, round(r.running, 6)) for r in got] == [("c", 2, 1.2)]


def test_watch_calls_its_state_once_a_bucket(monkeypatch):
    import pandas as pd

    from memloom.streaming import spend

    class Map(dict):
        calls = 0
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        removeKey = dict.pop

        def updateValue(self, k, x):
            self.calls += 1
            self[k] = x

        def iterator(self):
            return iter(list(self.items()))

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

    class Handle:
        timers: list = []
        getMapState = lambda self, *a: Map()
        getValueState = lambda self, *a: Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    watch, handle, n = spend.CeilingWatch(1.0), Handle(), 5000
    watch.init(handle)
    turns = pd.DataFrame({"seq": range(n), "at": [1_000_000 + 10_000 * (n - i) for i in range(n)], "cost": [1.0 / 4096] * n})
    list(watch.handleInputRows(("c",), iter([turns, turns[:7]]), Now(0)))
    assert watch.waiting.calls == spend.BUCKETS and handle.timers == [1011]
    assert list(watch.handleExpiredTimer(("c",), Now(2000), Now(1011))) == [] and handle.timers == [1011, 2001]
    (alert,) = watch.handleExpiredTimer(("c",), Now(10**6), Now(2001))
    assert (alert["seq"][0], alert["running"][0]) == (n - 4096, 1.0) and not watch.waiting and watch.spent.held[1]


def test_edges_of_queries_meet_as_numbers(spark):
    from memloom.operators import graph

    reached = spark.createDataFrame([("q1", e) for e in "abc"] + [("q2", e) for e in "bd"], "query_id string, entity_id string")
    rows = [("r1", "a", "b"), ("r1", "a", "b"), ("r2", "b", "c"), ("r3", "b", "d"), ("r4", "c", "e"), ("r5", "b", "b")]
    relations = spark.createDataFrame(rows, "rel_id string, from_entity string, to_entity string")
    assert {c for c, _ in graph.edge_hits(reached, relations)[0].dtypes} == {"q", "rel"}
    got = sorted((r.query_id, r.rel_id) for r in graph.edges_within(reached, relations).collect())
    assert got == [("q1", "r1"), ("q1", "r2"), ("q1", "r5"), ("q2", "r3"), ("q2", "r5")]


def test_same_requests_are_asked_once(spark):
    from memloom.operators import graph

    rows = [("x1", "t", "u", None, "N"), ("x2", "t", "u", None, "N"), ("x3", "t", "u", "p", "N"), ("x4", "t", "u", "p", "M"), ("x5", "t", "u", "p", "M")]
    asked, members = graph.distinct_requests(spark.createDataFrame(rows, "query_id string, tenant string, user_id string, project string, name string"))
    assert sorted(r.query_id for r in asked.collect()) == ["x1", "x3", "x4"]
    assert sorted((r.query_id, r.same) for r in members.collect()) == [("x1", "x1"), ("x2", "x1"), ("x3", "x3"), ("x4", "x4"), ("x5", "x4")]


def test_lists_of_centres_find_the_neighbours(spark):
    import numpy as np

    from memloom.operators import knn

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    vectors = centres[rng.integers(0, 8, 600)] + 0.3 * rng.normal(size=(600, 16))
    held = spark.createDataFrame([(f"{i:04d}", x.tolist()) for i, x in enumerate(vectors)], "item_id string, embedding array<float>")
    asked = held.where("item_id % 20 = 0").selectExpr("item_id AS query_id", "embedding AS vector")
    got = {(r.query_id, r.item_id) for r in knn.ivf_knn_join(asked, held, 5, block_rows=50).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(f"{i:04d}", f"{j:04d}") for i in range(0, 600, 20) for j in np.argsort(-(unit @ unit[i]))[:5]}
    assert len(got) == 150 and len(got & want) >= 0.9 * len(want)
    everything = {(r.query_id, r.item_id) for r in knn.ivf_knn_join(asked, held, 5, probes=64, block_rows=50).collect()}
    assert everything == want


def test_candidates_of_writes_are_not_copied_to_every_block(spark, monkeypatch):
    """Targets of scattered writes with a few near copies are found without dealing a vector to a block."""
    import numpy as np

    from memloom.operators import knn, reconcile

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 120))
    rows = np.concatenate([base, base[:20] + rng.normal(size=(20, 120)) * 0.05])
    held = spark.createDataFrame([(f"r{n:03d}", "t", "u", "p", [float(x) for x in v], n, n) for n, v in enumerate(rows)],
                                 "row_id string, tenant string, user_id string, project string, vector array<float>, first_seq long, last_seq long")
    wanted = held.select("row_id", F.col("first_seq").alias("open_seq"))
    nothing = held.select("row_id", F.lit(0).cast("long").alias("dead_seq")).limit(0)
    dealt, plain = [], knn._compare

    def compare(l, r, *more):
        dealt.append(l.count() + r.count())
        return plain(l, r, *more)

    monkeypatch.setattr(knn, "_compare", compare)
    got = reconcile._candidates(held, wanted, nothing, 16, reconcile.ReconcileConfig(block_rows=8)).collect()
    assert {(r.row_id, r.target) for r in got} == {(f"r{60 + n:03d}", f"r{n:03d}") for n in range(20)}
    assert sum(dealt) == 0


def test_neighbours_of_links_are_those_of_all_edges(spark, sf_dir, monkeypatch):
    """A search reads the neighbours of what it asks for and never makes the edges of all items."""
    from memloom.catalog import retrieval_catalog, views
    from memloom.operators import graph

    mentions = views.mentions(spark, sf_dir)
    relations, links = graph.edge_weight(graph.cooccurrence_pairs(mentions)), graph.item_links(mentions)
    asked = links.select("entity_id").distinct().where("conv(right(entity_id, 1), 16, 10) < 4")
    for most in (None, 3):
        assert sorted(graph.adjacency(None, asked, most, links).collect()) == sorted(graph.adjacency(relations, asked, most).collect())
    seeds = asked.select(F.right("entity_id", F.lit(2)).alias("query_id"), "entity_id")
    over = [graph.graph_expand(seeds, r, 2, 9, links).collect() for r in (None, relations)]
    assert sorted(over[0]) == sorted(over[1]) and any(r.truncated for r in over[0])

    def no_pairs(*_):
        raise AssertionError("all pairs were made")

    views._stored.clear()
    monkeypatch.setattr(graph, "cooccurrence_pairs", no_pairs)
    assert retrieval_catalog.graph_branch(spark, sf_dir).count() > 0


def test_mentions_are_whole_words_once_an_item(spark, monkeypatch):
    from memloom.catalog import views

    text = "Lisbon LISBON xLisbon Lisbonx Lisbon2Madrid, Lisbon\nLisbonA Berliné Madrid Rome"
    held = spark.createDataFrame([("t", "u", "p", "i", 1, text), ("t", "u", "p", "j", 2, None)],
                                 "tenant string, user_id string, project string, item_id string, seq long, content string")
    got = views.mentions(spark, "", lambda s, d: held).select("item_id", "pos", "name").collect()
    assert sorted(map(tuple, got)) == [("i", 0, "lisbon"), ("i", 1, "lisbonx"), ("i", 2, "madrid"), ("i", 3, "berlin")]


def test_text_scores_are_dealt_to_as_many_partitions_as_they_need(spark, monkeypatch):
    """Few postings make very many scores, so partitions follow the scores and not the size of the postings."""
    from memloom.operators import fts

    scope = ["'t' AS tenant", "'u' AS user_id", "'p' AS project"]
    items = spark.range(400).selectExpr(*scope, "format_string('i%03d', id) AS item_id", "'note' AS type", "CAST(NULL AS STRING) AS superseded_by",
                                        "timestamp_seconds(id) AS updated_at", "concat('common word', id % 7) AS content")
    queries = spark.range(50).selectExpr("concat('q', id) AS query_id", *scope, "concat('common word', id % 7) AS query")
    plain = sorted(map(tuple, fts.fts_branch(queries, items, 5).collect()))
    index = fts.postings(items)
    asked, real = [], fts.fts_scores

    def scores(q, held, *args, **more):
        asked.append(held.rdd.getNumPartitions())
        return real(q, held, *args, **more)

    monkeypatch.setattr(fts, "fts_scores", scores)
    monkeypatch.setattr(fts, "SCORES", 1000)
    for given in (None, index):
        assert sorted(map(tuple, fts.fts_branch(queries, items, 5, index=given).collect())) == plain
    assert min(asked) >= 20 and max(asked) <= 24


def test_vectors_of_writes_stay_where_they_are(spark, monkeypatch):
    """What a search knows of its rows is sent to them; their vectors are not dealt by row for it."""
    from memloom.operators import reconcile

    held = spark.createDataFrame([(f"r{n}", "t", "u", "p", [float(n), 1.0], n, n) for n in range(9)],
                                 "row_id string, tenant string, user_id string, project string, vector array<float>, first_seq long, last_seq long")
    wanted = held.select("row_id", F.col("first_seq").alias("open_seq"))
    dead = held.where("first_seq < 3").select("row_id", F.col("first_seq").alias("dead_seq"))
    sides, real = [], reconcile.blocked_similarity

    def search(left, right, *more, **named):
        sides.extend([left, right])
        return real(left, right, *more, **named)

    monkeypatch.setattr(reconcile, "blocked_similarity", search)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reconcile._candidates(held, wanted, dead, 4, reconcile.ReconcileConfig())
        plans = [side._jdf.queryExecution().executedPlan().toString() for side in sides]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p for p in plans)


def test_knn_join_copies_rows_by_size_not_by_count(spark, sf_dir, monkeypatch):
    dealt, plain = [], knn._compare

    def compare(l, r, *rest):
        dealt.append((l.count(), r.count()))
        return plain(l, r, *rest)

    monkeypatch.setattr(knn, "_compare", compare)
    from memloom.catalog.retrieval_catalog import knn_join

    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert knn_join(spark, sf_dir).count() == 5 * n
    assert sum(a + b for a, b in dealt) <= 3 * n


def test_few_queries_are_sent_to_the_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16)).round(1)
    vectors[::7], vectors[3] = vectors[1], 0
    rows = [("t", "u", f"p{i % 2}", f"i{i:04d}", "fact" if i % 3 else "note", None, v.tolist()) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "tenant string, user_id string, project string, item_id string, type string, superseded_by string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", "t", "u", [None, "p0", "p1"][i % 3], vectors[i].tolist(), [None, ["note"], []][i % 3 - 1]) for i in range(9)],
                                  "query_id string, tenant string, user_id string, project string, vector array<float>, types array<string>")
    for queries in (asked, asked.drop("types")):
        got = knn.knn_join(queries, items, 7)
        plan = got._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.knn_join(queries, items, 7, block_rows=64).collect()))


def test_slices_of_scores_keep_the_best_of_all():
    rng = np.random.default_rng(5)
    for rows, cols, k, tied in ((3, 4, 5, False), (1200, 2600, 7, False), (1200, 2600, 7, True)):
        a, b = rng.normal(size=(rows, 8)), rng.normal(size=(cols, 8))
        if tied:
            b[::2], b[1::5] = b[0], 0
        a, b = (x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None] for x in (a, b))
        names = np.array([f"i{j:05d}" for j in range(cols)], dtype=object)
        kept = best.Best(rows, k)
        for part in (slice(cols // 2, None), slice(0, cols // 2)):
            best.add_nearest(kept, a, b[part], names[part])
        score = np.round(a @ b.T, 9)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        assert set(zip(kept.row, kept.tie)) == {(r, names[c]) for r in range(rows) for c in top[r]}


def test_many_queries_are_scored_by_blocks(spark, sf_dir, monkeypatch):
    """Blocks give the rows of the plain way: null projects, types, ties, superseded items, repeated and missing terms."""
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(30)] + ["the", "é", "cafés"]
    text = lambda n: " ".join(words[int(x)] for x in np.minimum(rng.geometric(0.15, n), len(words)) - 1)
    items = [("t", f"u{i % 2}", f"p{i % 3}", f"i{i:04d}", "fact" if i % 4 else "note", "x" if i % 9 == 0 else None, i % 5, [text(i % 40), "", None][0 if i % 17 else i % 3]) for i in range(300)]
    held = spark.createDataFrame(items, "tenant string, user_id string, project string, item_id string, type string, superseded_by string, n long, content string").withColumn(
        "updated_at", F.timestamp_seconds("n")).drop("n").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", "t", f"u{i % 3}", [None, "p0", "p1"][i % 3], [text(6), "", "the", "nothing known"][i % 4], [None, ["note"], []][i % 3 - 1]) for i in range(40)],
                                  "query_id string, tenant string, user_id string, project string, query string, types array<string>")
    monkeypatch.setattr(best, "COLUMNS", 16)
    monkeypatch.setattr(fts, "BLOCK_ROWS", 50)
    cases = [(q, rank, index) for q in (asked, asked.drop("types")) for rank in ("cover_density", "coverage") for index in (None, fts.postings(held))]
    for rare in (150, 3):
        monkeypatch.setattr(fts, "_RARE", rare)
        for queries, rank, index in cases[rare == 3::3]:
            found = []
            for least in (10**9, 0):
                monkeypatch.setattr(fts, "BLOCK_QUERIES", least)
                found.append(sorted(map(tuple, fts.fts_branch(queries, held, 6, rank, index=index).collect())))
            assert found[0] == found[1] and len(found[0]) > 30


def test_spend_that_reaches_the_ceiling_exactly_raises_its_alert(spark, tmp_path):
    from memloom.streaming.spend import spend_alerts, stream_spend_alerts

    # Ten times 0.1 is less than 1 when added one by one; days of their own add up in any order.
    rows = [(c, s, f"2024-01-{1 + s * step:02d} 00:00:{s:02d}", 0.1) for c, step in (("one day", 0), ("many", 1)) for s in range(10)]
    usage = spark.createDataFrame(rows + [("none", 99, "2024-06-01 00:00:00", 0.0)], "conversation_id string, seq long, ts string, cost_usd double")
    usage = usage.withColumn("ts", F.col("ts").cast("timestamp"))
    told = lambda df: sorted((r.conversation_id, r.seq, r.running) for r in df.collect())
    assert told(spend_alerts(usage, 1.0)) == [("many", 9, 1.0), ("one day", 9, 1.0)]
    usage.write.parquet(f"{tmp_path}/used")
    stream = stream_spend_alerts(spark.readStream.schema(usage.schema).parquet(f"{tmp_path}/used"), 1.0)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(f"{tmp_path}/out")) == [("many", 9, 1.0), ("one day", 9, 1.0)]


def test_few_waiting_turns_take_one_entry_of_the_state():
    from memloom.streaming import spend

    kept = {}
    watch = spend.CeilingWatch(1.0)
    watch.waiting = type("Map", (), {"updateValue": staticmethod(kept.__setitem__)})
    assert watch._keep(3, list(range(50)), [0] * 50, [1] * 50) == 4 and list(kept) == [(3,)]


def test_ties_of_full_text_rank_by_recency_and_those_of_other_branches_by_id(spark):
    from memloom.operators.fusion import rank_in_branch

    hits = [("q", b, i, s, day) for b in ("fts", "graph", "vector") for i, s, day in (("a", 1.0, 1), ("b", 1.0, 2), ("c", 2.0, 0), ("d", 1.0, 2))]
    ranked = rank_in_branch(spark.createDataFrame(hits, "query_id string, branch string, item_id string, score double, updated_at long"))
    order = lambda branch: "".join(r.item_id for r in ranked.where(F.col("branch") == branch).orderBy("rank").collect())
    assert (order("fts"), order("graph"), order("vector")) == ("cbda", "cabd", "cabd")


def test_rank_in_branch_ranks_every_branch(spark, sf_dir):
    from memloom.catalog import load

    assert {r.branch for r in load()[0]["rank_in_branch"](spark, sf_dir).select("branch").distinct().collect()} == {"fts", "graph", "vector"}


def test_explore_answers_as_the_table_of_edges_does(spark, monkeypatch):
    import random

    from memloom.operators import explore, graph, reports

    for name, small in (("CHUNK_ROOTS", 5), ("BLOCK_PAIRS", 40), ("LONG", 3), ("BATCH_BYTES", 500)):
        monkeypatch.setattr(explore, name, small)
    draw = random.Random(4)
    told = [("t", "u", f"p{i % 2}", f"i{i:02d}", i, [(f"Name{chr(97 + draw.randrange(14) % draw.randrange(1, 15))}", "concept") for _ in range(draw.randrange(5))]) for i in range(40)]
    listed = spark.createDataFrame(told, "tenant string, user_id string, project string, item_id string, seq long, entities array<struct<name:string,kind:string>>")
    mentions = graph.named_entities(listed)
    entities, links, edges = graph.entity_merge(mentions), graph.item_links(mentions), graph.edge_weight(graph.cooccurrence_pairs(mentions))
    items = listed.select("tenant", "user_id", "project", "item_id", F.lit("note").alias("type"), F.concat(F.lit("text "), "seq").alias("content"),
                          F.timestamp_seconds(F.col("seq") % 7).alias("updated_at"), F.when(F.col("seq") % 9 == 0, "x").alias("superseded_by"))
    rows = [(f"{n}{p}", "t", "u", p, f"NAME{n}") for n in "ABCDEFGHIJKLMNZ" for p in ("p0", "p1", None)]
    requests = spark.createDataFrame(rows, "query_id string, tenant string, user_id string, project string, name string")
    want = {r.query_id: r.report for r in reports.graph_text_report(requests, graph.graph_explore(requests, items, entities, edges, links, limit=6), items, 1).collect()}
    answers = explore.explore(requests, items, entities, mentions, limit=6)
    got = reports.explored_text_report(answers).unionByName(reports.missing_entity_report(requests, entities))
    assert {r.query_id: r.report for r in got.collect()} == want and len(want) == len(rows)
    cut = explore.explore(requests, items, entities, mentions, max_nodes=4, texts=False)
    reached = graph.graph_expand(graph.find_entity(requests, entities), edges, 1, 4)
    count = {r.query_id: (r.n, r.cut) for r in reached.groupBy("query_id").agg(F.count("*").alias("n"), F.max("truncated").alias("cut")).collect()}
    assert {q: (r.entities, r.truncated) for r in cut.collect() for q in r.query_ids} == count
    assert any(c for _, c in count.values())


def test_grams_of_many_queries_are_not_broadcast(spark, tmp_path):
    from memloom.operators import graph

    made = lambda n: spark.createDataFrame([(f"q{i}", "t", "u", None, f"about Marble{i % 7} " + "words " * 200) for i in range(n)],
                                           "query_id string, tenant string, user_id string, project string, query string")
    made(150).write.parquet(f"{tmp_path}/many")
    entities = spark.createDataFrame([("t", "u", "p", f"e{i}", f"Marble{i}", f"marble{i}") for i in range(7)],
                                     "tenant string, user_id string, project string, entity_id string, name string, name_norm string")
    many = graph.link_entities(spark.read.parquet(f"{tmp_path}/many"), entities)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" not in plan
    assert {(r.query_id, r.entity_id) for r in many.collect()} == {(f"q{i}", f"e{i % 7}") for i in range(150)}
    assert {(r.query_id, r.entity_id) for r in graph.link_entities(made(3), entities).collect()} == {(f"q{i}", f"e{i}") for i in range(3)}


def test_bounds_of_large_frontiers_change_nothing(spark, monkeypatch):
    import random

    from memloom.operators import graph

    draw = random.Random(11)
    links = spark.createDataFrame({(i, draw.randrange(60) if draw.random() < 0.8 else 7) for i in range(90) for _ in range(4)}, "item_id long, entity_id long")
    seeds = spark.createDataFrame([(q, draw.randrange(60)) for q in range(8)], "query_id long, entity_id long")
    run = lambda: {tuple(r) for r in graph.graph_expand(seeds, None, 3, 20, links).select("query_id", "entity_id", "hop", "truncated").collect()}
    want = run()
    monkeypatch.setattr(graph, "FEW_ROWS", 0)
    bounded = []
    held = graph.neighbour_lists
    monkeypatch.setattr(graph, "neighbour_lists", lambda *a: bounded.append(a) or held(*a))
    assert run() == want and bounded and any(cut for *_, cut in want)
    monkeypatch.setattr(graph, "neighbour_lists", held)
    edges = links.alias("a").join(links.alias("b"), "item_id").where("a.entity_id < b.entity_id").select(F.col("a.entity_id").alias("from_entity"), F.col("b.entity_id").alias("to_entity")).distinct()
    one = graph.expand_frontier(seeds, edges)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "entity_id").collect())
    assert rows(graph.unseen_neighbours(seeds, None, seeds.limit(0), links)) == rows(one)
    assert rows(graph.unseen_neighbours(one, None, one, links)) == rows(graph.expand_unseen(graph.expand_frontier(one, edges), one))


def test_low_confidence_report_leaves_other_refusals_to_the_whole_report(spark):
    from memloom.operators import conversations

    writes = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9), (4, 0.75)], "seq long, confidence double")
    outcomes = spark.createDataFrame([(1, "rejected", "confidence 0.50 below threshold 0.6"), (2, "rejected", "privacy filter: aws-access-key"),
                                      (3, "rejected", "privacy filter: aws-access-key"), (4, "inserted", None)], "seq long, outcome string, reason string")
    low = conversations.low_confidence_report(outcomes, writes, 0.6)
    assert sorted(map(tuple, low.collect())) == [(s, "confidence 0.50 below threshold 0.6") for s in (1, 2)]
    assert conversations.rejected_report(outcomes).count() == 3


def test_relations_are_not_shuffled_to_delete_a_scope(spark, tmp_path):
    from memloom.operators import store

    # Above the planner's own bound, so that only the counted size allows the broadcasts.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.createDataFrame([("t", u, "p", f"i{u}", None) for u in "ab"], "tenant string, user_id string, project string, item_id string, superseded_by string")
        entities = spark.createDataFrame([("t", u, "p", f"e{u}{n}") for u in "ab" for n in (1, 2)], "tenant string, user_id string, project string, entity_id string")
        relations = spark.createDataFrame([("r1", "ea1", "ea2", "ia"), ("r2", "eb1", "eb2", "ia"), ("r3", "eb1", "eb2", "ib"), ("r4", "eb1", "ea2", None)],
                                          "rel_id string, from_entity string, to_entity string, evidence_item string")
        left = store.delete_scope({"items": items, "entities": entities, "relations": relations}, items.where("user_id = 'a'"))["relations"]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 3
        assert sorted((r.rel_id, r.evidence_item) for r in left.collect()) == [("r2", None), ("r3", "ib")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
