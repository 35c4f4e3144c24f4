"""Golden cases and invariants of the operators on small inputs."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memloom.functions import redact, render, scope, scoring, text, tokens, vectors
from memloom.operators import conversations as conv
from memloom.operators import evaluation as ev
from memloom.operators import fts, fusion, graph, items as ops, knn, pack, rerank, store
from memloom.operators.embed import hash_embedder
from memloom.plans import search as plans
from memloom.plans import writeback as wb
from memloom.plans.ingest import write_items
from memloom.schemas import ITEM, SCOPE
from memloom.sources import docs



def NOW():
    """The fixed clock, built on use: columns need a running session."""
    return F.lit(datetime(2024, 6, 1)).cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value):
    return F.lit(value)


@pytest.mark.parametrize("raw, want", [
    ("Kiến trúc, được!", "kien truc đuoc"), ("  A--b_C 12 ", "a b c 12"), ("", ""), ("çéÀ", "cea"), ("が", "か"),
])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_text(lit(raw))) == want


def test_tokens_and_overlap(spark):
    assert one(spark, text.tokenize(lit("The cat is on a mat, the CAT"))) == ["cat", "mat", "cat"]
    assert one(spark, text.jaccard(text.token_set(lit("red fox")), text.token_set(lit("fox den")))) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(text.token_set(lit("the")), text.token_set(lit("fox")))) == 0.0


def test_snippet(spark):
    long = "alpha " * 60 + "needle here " + "omega " * 60
    cut = one(spark, text.snippet(lit(long), lit("needle"), 90))
    assert "needle here" in cut and cut.startswith("…") and cut.endswith("…") and len(cut) <= 92
    assert one(spark, text.snippet(lit("short  text"), lit("x"), 90)) == "short text"
    assert one(spark, text.snippet(lit("b" * 100), lit("needle"), 50)) == "b" * 49 + "…"


@pytest.mark.parametrize("raw, n", [("", 0), ("abcdefg", 3), ("記憶記憶", 4), ("ab記", 2)])
def test_estimate(spark, raw, n):
    assert one(spark, tokens.estimate_tokens(lit(raw))) == n


@pytest.mark.parametrize("raw", ["plain words that go on and on for a while without end", "記憶 mixed 記憶記憶 text 記 here and more", "x" * 80])
def test_truncate_fits_and_is_longest(spark, raw):
    def cost(s):
        wide = sum(0x3000 <= ord(c) <= 0x9FFF for c in s)
        return math.ceil(wide + (len(s) - wide) / 3.4)

    for budget in (1, 3, 5, 8, 500):
        cut = one(spark, tokens.truncate_to_tokens(lit(raw), lit(budget)))
        best = max(n for n in range(len(raw) + 1) if cost(raw[:n]) <= budget)
        want = raw[:best]
        if cost(raw) > budget:
            space = want.rfind(" ")
            want = (want[:space] if space > best * 0.6 else want).rstrip()
        assert cut == want
    assert one(spark, tokens.truncate_to_tokens(lit(raw), lit(0))) == ""


def test_redaction_goldens(spark):
    rows = [
        ("gh" + "p_" + "a1" * 12, "github-token", None), ("ey" + "J" + ".".join(["abcdefgh12"] * 3), "jwt", None),
        ("my_password = hunter2222", None, "my_password=[redacted]"), ("password = hunter2222", None, "password = hunter2222"),
        ("postgres://bob:pw@host/db", None, "postgres://bob:[redacted]@host/db"),
        ("mail a.b@c-d.org now", None, "mail [email] now"), ("card 4111111111111111.", None, "card [card]."),
        ("run 4111111111111112.", None, "run 4111111111111112."), ("éghp_" + "a1" * 12, "github-token", None),
        ("xghp_" + "a1" * 12, None, "xghp_" + "a1" * 12), ("Authorization: Basic zzz", None, "[redacted] zzz"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, content string")
    got = {r["i"]: r for r in redact.redact(df).collect()}
    for i, (_, name, masked) in enumerate(rows):
        assert got[i]["rejected_by"] == name, rows[i]
        if masked is not None:
            assert got[i]["redacted"] == masked
    assert got[7]["hits"] == ["card-number"]
    again = redact.redact(spark.createDataFrame([(r["i"], r["redacted"]) for r in got.values()], "i int, content string"))
    assert {r["i"]: r["redacted"] for r in again.collect()} == {i: r["redacted"] for i, r in got.items()}
    strict = redact.redact(df, rules=redact.mask_rules(strict_names=True)).collect()
    assert {r["i"]: r["redacted"] for r in strict}[3] == "password=[redacted]"


def test_scope_headers(spark):
    cases = {"a/b/c": None, "a/b/*": None, "a/b": "must be tenant/user/project", "a/b/c/d": "must be tenant/user/project",
             "/b/c": "bad tenant", "a/b c/d": "bad user", "a/b/.x": "bad project", "": "header is required"}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r["h"]: r["s"] for r in df.select("h", scope.parse_scope_header(F.col("h")).alias("s")).collect()}
    assert {h: s["error"] for h, s in got.items()} == cases
    assert got["a/b/*"]["project"] is None and got["a/b/c"]["project"] == "c"


def test_fusion_formula_and_report(spark):
    hits = spark.createDataFrame([("q", "vector", "a", 1), ("q", "vector", "b", 2), ("q", "fts", "b", 1), ("q", "fts", "c", 2)],
                                 "query_id string, branch string, item_id string, rank int")
    fused = {r["item_id"]: r for r in fusion.rrf_fuse(hits).collect()}
    assert fused["b"]["fused"] == pytest.approx(1 / 62 + 0.9 / 61, abs=1e-11) and fused["b"]["position"] == 1
    assert fused["b"]["ranks"] == {"vector": 2, "fts": 1}
    status = spark.createDataFrame([("q", "graph", "off", None), ("q", "fts", None, "slow")],
                                   "query_id string, branch string, unavailable_reason string, degraded_reason string")
    report = fusion.fusion_report(spark.createDataFrame([("q",), ("r",)], "query_id string"), hits, status)
    rows = {r["query_id"]: r for r in report.collect()}
    assert rows["q"]["degraded"] == ["fts", "graph"] and rows["q"]["reasons"] == {"fts": "slow", "graph": "off"}
    assert rows["r"]["branches"] == {"vector": 0, "fts": 0, "graph": 0} and len(rows["r"]["degraded"]) == 3


def test_pack_invariants(spark):
    rows = [(i + 1, f"item_{i}", ("word " * (200 if i == 0 else 12 + i)).strip()) for i in range(30)]
    cand = spark.createDataFrame(rows, "position int, item_id string, content string").select(
        "*", F.lit("q").alias("query_id"), F.lit("word").alias("query"), F.lit("fact").alias("type"), F.lit("s").alias("source"),
        NOW().alias("created_at"), F.lit(0.5).alias("fused"), F.create_map().cast("map<string,int>").alias("ranks"))
    for budget in (0, 60, 100, 150, 400, 1200):
        r = pack.pack_context(cand, budget).first()
        assert r["used_tokens"] <= budget
        assert r["packed_omitted"] + len(r["citations"]) == 30
        used = one(spark, tokens.estimate_tokens(lit(r["context"])))
        assert used <= budget or not r["context"]
        if budget >= 400:
            assert len(r["citations"]) >= 3


def test_heuristic_rerank(spark):
    rows = [("q", "a", "red fox den", "note", 0.02, 1.0), ("q", "b", "unrelated text", "decision", 0.02, 1.0), ("q", "c", "red fox", "decision", 0.02, 0.1)]
    cand = spark.createDataFrame(rows, "query_id string, item_id string, content string, type string, fused double, confidence double").select(
        "*", F.lit("red fox").alias("query"), NOW().alias("updated_at"), F.lit(1).alias("position"))
    got = {r["item_id"]: r for r in rerank.heuristic_rerank(NOW())(cand).collect()}
    assert got["a"]["fused"] == pytest.approx(0.55 + 0.25 * 2 / 3 + 0.02 + 0.1)
    assert got["b"]["fused"] == pytest.approx(0.55 + 0.1 + 0.1) and got["c"]["position"] == 3
    assert one(spark, scoring.recency_decay(lit(datetime(2023, 12, 4)).cast("timestamp"), NOW())) == pytest.approx(0.5)


def small_store(spark):
    """Three scopes share a project name; words are disjoint per item."""
    rows = []
    for s, (tenant, user) in enumerate([("t1", "ann"), ("t1", "bob"), ("t2", "ann")]):
        for i in range(12):
            rows.append((f"item_{s}{i:02d}", tenant, user, "p", "fact", f"shared topic{i} unique{s}x{i} words", f"h{s}{i}", "s", 1.0,
                         datetime(2024, 1, 1 + i), datetime(2024, 1, 1 + i), None, None, "hash-v1"))
    plain = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ITEM.fields[:-1]))
    return hash_embedder("content")(plain.withColumn("confidence", F.col("confidence").cast("float")))


def test_search_isolation_and_blocks(spark):
    items = small_store(spark).cache()
    q = spark.createDataFrame([("q1", "t1", "ann", "p", "topic3 unique0x3"), ("q2", "t1", "ann", None, "shared topic5"), ("q3", "t9", "x", "p", "shared"),
                               ("q4", "t1", "bob", "p", "the of"), ("q5", "t1", "bob", "p", "  ")],
                              "query_id string, tenant string, user_id string, project string, query string")
    mentions = graph.named_entities(items.select(
        "item_id", F.lit(1).cast("long").alias("seq"), *SCOPE,
        F.array(F.struct(F.element_at(F.split("content", " "), 2).alias("name"), F.lit(None).cast("string").alias("kind")),
                F.struct(F.lit("shared").alias("name"), F.lit("topic").alias("kind"))).alias("entities")))
    tables = plans.Store(items, graph.entity_merge(mentions), graph.edge_weight(graph.cooccurrence_pairs(mentions)), graph.item_links(mentions))
    results = {r["query_id"]: r for r in plans.hybrid_search(q, tables, NOW(), plans.SearchConfig(limit=5)).collect()}
    assert results["q1"]["citations"][0]["id"] == "item_003"
    for key in ("q1", "q2"):
        assert all(c["id"].startswith("item_0") for c in results[key]["citations"])
        assert results[key]["total"] == len(results[key]["citations"]) + results[key]["omitted"]
    assert results["q3"]["total"] == 0 and len(results["q3"]["degraded"]) == 3
    assert "stopword" in results["q4"]["reasons"]["fts"]
    assert results["q5"]["reasons"] == {"query": "empty query"}
    embedded = plans.embed_queries(q)
    whole = knn.knn_join(embedded, items, 7).select("query_id", "item_id", "rank").collect()
    cut = knn.knn_join(embedded, items, 7, block_rows=3).select("query_id", "item_id", "rank").collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut)) and len(whole) == 4 * 7
    typed = embedded.withColumn("types", F.array(F.lit("note")))
    assert knn.knn_join(typed, items, 7).count() == 0
    items.unpersist()


def test_graph_rounds(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")] + [("hub", f"n{i:03d}") for i in range(30)]
    rel = spark.createDataFrame(edges, "from_entity string, to_entity string")
    seeds = spark.createDataFrame([("q", "c"), ("h", "hub")], "query_id string, entity_id string")
    got = graph.graph_expand(seeds, rel, 2, max_nodes=10).collect()
    line = {r["entity_id"]: r["hop"] for r in got if r["query_id"] == "q"}
    assert line == {"c": 0, "b": 1, "d": 1, "a": 2, "e": 2}
    hub = [r for r in got if r["query_id"] == "h"]
    assert len(hub) == 10 and all(r["truncated"] for r in hub)
    assert not any(r["truncated"] for r in got if r["query_id"] == "q")


def test_edges_cap_and_order(spark):
    rows = [(f"i{n}", n, [("Alpha", None), ("beta", "component"), ("ALPHA", "tool"), (" ", None)]) for n in range(20)]
    items = spark.createDataFrame(rows, "item_id string, seq long, entities array<struct<name:string,kind:string>>").select(
        "*", F.lit("t").alias("tenant"), F.lit("u").alias("user_id"), F.lit("p").alias("project"))
    m = graph.named_entities(items)
    merged = {r["name_norm"]: r for r in graph.entity_merge(m).collect()}
    assert merged["alpha"]["name"] == "Alpha" and merged["alpha"]["kind"] == "tool" and merged["beta"]["kind"] == "component"
    edge = graph.edge_weight(graph.cooccurrence_pairs(m)).collect()
    assert len(edge) == 1 and edge[0]["weight"] == 5.0 and edge[0]["evidence_item"] == "i19"


def test_store_cascades(spark):
    rows = [("a", "b", None), ("b", "c", "conv1"), ("c", None, "conv2"), ("x", "y", None), ("y", "x", None)]
    items = spark.createDataFrame(rows, "item_id string, superseded_by string, conversation_id string").select(
        "*", F.lit("t").alias("tenant"), F.lit("u").alias("user_id"), F.lit("p").alias("project"))
    links = spark.createDataFrame([("c", "e1"), ("a", "e1")], "item_id string, entity_id string")
    rel = spark.createDataFrame([("r1", "e1", "e2", "c")], "rel_id string, from_entity string, to_entity string, evidence_item string")
    chain = {r["item_id"]: (r["current_id"], r["hops"]) for r in store.supersede_chain(items).collect()}
    assert chain == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None), "y": (None, None)}
    asked = spark.createDataFrame([("t", "u", None, "conv2")], "tenant string, user_id string, project string, conversation_id string")
    out = store.undo_conversation({"items": items, "links": links, "relations": rel}, asked)
    assert {r["item_id"]: r["superseded_by"] for r in out["items"].collect()} == {"a": "b", "b": None, "x": "y", "y": "x"}
    assert out["links"].count() == 1 and out["relations"].first()["evidence_item"] is None


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "query_id string, latency_ms double")
    rel = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "query_id string, item_id string")
    got = spark.createDataFrame([("a", "x", 2), ("a", "w", 1), ("a", "y", 7), ("b", "w", 1)], "query_id string, item_id string, rank int")
    m = {r["query_id"]: r for r in ev.query_metrics(ev.judged(q, rel, got)).collect()}
    assert (m["a"]["recall_at_5"], m["a"]["recall_at_10"], m["a"]["mrr_at_10"]) == (0.5, 1.0, 0.5)
    ideal = 1 + 1 / math.log2(3)
    assert m["a"]["ndcg_at_10"] == pytest.approx((1 / math.log2(3) + 1 / 3) / ideal)
    assert (m["b"]["recall_at_10"], m["c"]["recall_at_10"], m["c"]["ndcg_at_10"]) == (0.0, 1.0, 1.0)
    report = ev.eval_report(ev.query_metrics(ev.judged(q, rel, got))).first()
    assert (report["latency_p50"], report["latency_p95"], report["misses"]) == (20.0, 30.0, 1)
    assert sorted(r["query_id"] for r in ev.eval_misses(q, rel, got).collect()) == ["b", "c"]


MARKDOWN = """intro text

# Top
body of top

```bash
# not a heading
```
## Child ##
child body
~~~
# still fenced
~~~
### Leaf
# Next
next body
"""


def test_markdown_sections(spark):
    df = spark.createDataFrame([("docs/adr/x.md", MARKDOWN)], "path string, content string")
    got = [(r["breadcrumb"], r["body"]) for r in docs.md_sections(df).orderBy("pos").collect()]
    assert [g[0] for g in got] == ["", "Top", "Top > Child", "Next"]
    assert "# not a heading" in got[1][1] and "# still fenced" in got[2][1]


def test_read_docs_and_items(spark, tmp_path):
    body = "We chose this because it is simple. " * 6 + "See `run_job()` and `a/b/c/d`."
    for path in ("docs/adr/0001-x.md", "node_modules/p/README.md", ".hidden/README.md", ".claude/rules.mdx", "notes.md", "README.md"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"# Title\n\n{body}")
    read = docs.read_docs(spark, str(tmp_path))
    assert sorted(r["path"] for r in read.collect()) == [".claude/rules.mdx", "README.md", "docs/adr/0001-x.md", "notes.md"]
    items = {r["source"]: r for r in docs.docs_to_items(read).collect()}
    assert set(items) == {"repo:docs/adr/0001-x.md#title", "repo:.claude/rules.mdx#title", "repo:README.md#title"}
    assert items["repo:README.md#title"]["type"] == "decision" and items["repo:.claude/rules.mdx#title"]["type"] == "preference"
    names = [e["name"] for e in items["repo:docs/adr/0001-x.md#title"]["entities"]]
    assert names == ["run_job", "0001-x", "Title"]


def test_parse_facts(spark):
    raw = [("a", 'Sure! {"facts":[{"type":"fact","content":"water is wet}","confidence":7,"entities":[{"name":" W "},{"kind":"k"}]},'
                 '{"type":"fact","content":"short"},"text",null,{"type":"odd","content":"long enough text"},'
                 '{"type":"note","content":"no confidence","confidence":"0.1"}]} bye'),
           ("b", "nothing here"), ("c", '{"facts": [1, 2}'), ("d", '{"facts":[]}')]
    facts, errors = wb.parse_facts(spark.createDataFrame(raw, "conversation_id string, raw string"))
    got = [(r["content"], r["confidence"], [e["name"] for e in r["entities"]]) for r in facts.orderBy("fact_pos").collect()]
    assert got == [("water is wet}", 1.0, ["W"]), ("no confidence", 0.7, [])]
    assert {r["conversation_id"]: r["error"] for r in errors.collect()} == {"b": "no JSON object", "c": "invalid JSON"} or \
        {r["conversation_id"]: r["error"] for r in errors.collect()} == {"b": "no JSON object", "c": "no JSON object"}


def test_write_items_builds_graph(spark):
    rows = [(0, "fact", "Redis holds the session cache for logins", [("Redis", "tool"), ("sessions", None)])]
    writes = spark.createDataFrame(rows, "seq long, type string, content string, entities array<struct<name:string,kind:string>>").select(
        "*", F.lit("t").alias("tenant"), F.lit("u").alias("user_id"), F.lit("p").alias("project"), F.lit("s").alias("source"), F.lit(1.0).alias("confidence"))
    empty = {"items": spark.createDataFrame([], ITEM),
             "entities": spark.createDataFrame([], "entity_id string, tenant string, user_id string, project string, name string, name_norm string, kind string"),
             "links": spark.createDataFrame([], "item_id string, entity_id string"),
             "relations": spark.createDataFrame([], "rel_id string, from_entity string, to_entity string, type string, weight double, evidence_item string")}
    _, once = write_items(writes, empty, NOW())
    assert (once["entities"].count(), once["links"].count(), once["relations"].first()["weight"]) == (2, 2, 1.0)
    outcomes, twice = write_items(writes, once, NOW())
    assert outcomes.first()["outcome"] == "duplicate"
    assert (twice["entities"].count(), twice["links"].count(), twice["relations"].first()["weight"]) == (2, 2, 1.25)


def test_recent_tail_matches_whole(spark):
    rows = [("c", i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (i % 50)) for i in range(900)]
    m = spark.createDataFrame(rows, "conversation_id string, turn long, role string, text string")
    whole = "\n\n".join(("User: " if r[2] == "user" else "Assistant: ") + r[3] for r in rows)
    assert conv.recent_tail(m, 5000).first()["transcript"] == conv.OMITTED_MARK + whole[-5000:]
    assert conv.recent_tail(m, len(whole)).first()["transcript"] == whole


def test_spend_and_budget(spark):
    use = spark.createDataFrame([("c", 3.0), ("c", None), ("c", 2.5), ("d", None)], "conversation_id string, cost_usd double")
    convs = spark.createDataFrame([("c",), ("d",), ("e",)], "conversation_id string")
    got = {r["conversation_id"]: (r["allowed"], r["turns"]) for r in conv.budget_check(convs, use).collect()}
    assert got == {"c": (False, 3), "d": (True, 1), "e": (True, 0)}
    assert all(r["allowed"] for r in conv.budget_check(convs, use, 0).collect())


def test_fts_hot_token(spark):
    """One token that every item holds: nothing is dropped, the cap applies to ranks only."""
    items = spark.range(500).select(
        F.concat(F.lit("item_"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("item_id"), F.lit("t").alias("tenant"), F.lit("u").alias("user_id"),
        F.lit("p").alias("project"), F.lit("fact").alias("type"), F.lit(None).cast("string").alias("superseded_by"), NOW().alias("updated_at"),
        F.concat(F.lit("common "), F.expr("repeat('common ', cast(id % 3 as int))"), F.col("id").cast("string")).alias("content"))
    q = spark.createDataFrame([("q", "t", "u", "p", "common")], "query_id string, tenant string, user_id string, project string, query string")
    assert fts.fts_scores(q, fts.postings(items)).count() == 500
    top = fts.fts_branch(q, items, 3).orderBy("rank").collect()
    assert [r["item_id"] for r in top] == ["item_0002", "item_0005", "item_0008"] and top[0]["score"] == pytest.approx(0.3)


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0), lit(5.0)))) == pytest.approx(2 ** -0.5)
    assert one(spark, vectors.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0
    with pytest.raises(Exception, match="expected 3 dimensions"):
        spark.range(1).select(vectors.checked_dims(F.array(lit(1.0)), 3)).collect()
    assert one(spark, vectors.parse_embedding(lit("oops"))) is None


def test_titles_and_labels(spark):
    assert one(spark, render.derive_title(lit("  a\n b " + "c" * 80))) == ("a b " + "c" * 80)[:57] + "…"
    assert one(spark, render.slug(lit("Hello, World!! x"))) == "hello-world-x"
    assert one(spark, render.write_error(lit("fact"), lit(" "), lit("s"))) == "content is required"


@pytest.mark.parametrize("raw", ["a  b\t c", " \n lead", "a b", "é \x0b x  y", "tail  　", " a  b", ""])
def test_flatten_space(spark, raw):
    import re
    assert one(spark, text.flatten_space(lit(raw))) == re.sub(r"\s+", " ", raw).strip(" ")
