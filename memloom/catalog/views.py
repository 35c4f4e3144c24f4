"""Shapes derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import hash_of_content
from memloom.functions.text import STOPWORDS
from memloom.operators.embed import hash_embedder
from memloom.operators import graph
from memloom.schemas import SCOPE
from memloom.session import cut_lineage, ship_package, spread

EPOCH = 1704067200  # 2024-01-01 UTC
NOW = "2024-08-01 00:00:00"
LANGS = ["de", "en", "es", "fr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def now():
    return F.lit(NOW).cast("timestamp")


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table written once per session to the shared folder, as a store would hold it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = cut_lineage(build(spark, sf_dir), name)
    return _stored[key]


def _base_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    kind = F.element_at(
        F.array(*[F.lit(t) for t in ("decision", "fact", "preference", "procedure", "note", "artifact")]),
        (n % 6 + 1).cast("int"),
    )
    return d.select(
        F.concat(F.lit("item_"), F.lpad(n.cast("string"), 8, "0")).alias("item_id"),
        F.col("lang").alias("tenant"), F.concat(F.lit("u"), n % 2).alias("user_id"),
        F.concat(F.lit("p"), n % 3).alias("project"), kind.alias("type"), F.col("text").alias("content"),
        F.concat(F.lit("doc:"), "source").alias("source"),
        F.coalesce(0.5 + 0.5 * F.col("quality"), F.lit(0.75)).cast("float").alias("confidence"),
        F.timestamp_seconds(F.lit(EPOCH) + n * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH) + n * 60 + (n % 180) * 86400).alias("updated_at"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.when(n % 5 == 0, F.concat(F.lit("conv_"), n % 100)).alias("conversation_id"), n.alias("seq"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items over 24 scopes."""
    return _base_items(spark, sf_dir)


def flat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items in one scope."""
    return _base_items(spark, sf_dir).withColumns(
        {"tenant": F.lit("acme"), "user_id": F.lit("u"), "project": F.lit("p")}
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat items; a text copied later is superseded by its newest copy."""
    base = flat_items(spark, sf_dir)
    base = base.withColumn("_text", F.sha2("content", 256))
    newest = base.groupBy("_text").agg(F.max("item_id").alias("newest"))
    return base.join(newest, "_text").withColumn(
        "superseded_by", F.when(F.col("newest") != F.col("item_id"), F.col("newest"))
    ).drop("newest", "_text")


def _embedded(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hashed = build(spark, sf_dir).withColumn("content_hash", hash_of_content(F.col("content")))
        return hash_embedder("content")(hashed).withColumn("embedding_model", F.lit("hash-v1"))

    return run


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "items_embedded", _embedded(items))


def flat_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "flat_embedded", _embedded(flat_items))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries over varied scopes; a third of them span projects."""
    n = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), n).alias("query_id"),
        F.element_at(F.array(*[F.lit(x) for x in LANGS]), (n % 4 + 1).cast("int")).alias("tenant"),
        F.concat(F.lit("u"), n % 2).alias("user_id"),
        F.when(n % 3 != 0, F.concat(F.lit("p"), n % 3)).alias("project"), F.col("text").alias("query"),
    )


def flat_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).withColumns(
        {"tenant": F.lit("acme"), "user_id": F.lit("u"), "project": F.lit(None).cast("string")}
    )


def mentions(spark: SparkSession, sf_dir: str, held=items) -> DataFrame:
    """Items whose entities are the capitalised words of six letters or more anywhere in their text."""
    words = F.regexp_extract_all("content", F.lit("(?<![A-Za-z])[A-Z][a-z]{5,}(?![A-Za-z])"), F.lit(0))
    # A word's first place in its item decides; its later ones change nothing.
    kept = F.transform(F.array_distinct(words), F.lower)
    kind = lambda w: F.when(F.length(w) % 3 == 0, "component").otherwise("concept")
    listed = F.transform(kept, lambda w: F.struct(w.alias("name"), kind(w).alias("kind")))
    return graph.named_entities(held(spark, sf_dir).select(*SCOPE, "item_id", "seq", listed.alias("entities")))


def told(spark, sf_dir):
    """The mentions, read from the texts once for all tables that they give."""
    return stored(spark, sf_dir, "mentions", mentions)


def entities(spark, sf_dir):
    return stored(spark, sf_dir, "entities", lambda s, d: graph.entity_merge(told(s, d)))


def links(spark, sf_dir):
    return stored(spark, sf_dir, "links", lambda s, d: graph.item_links(told(s, d)))


def relations(spark, sf_dir):
    return stored(spark, sf_dir, "relations", lambda s, d: graph.edge_weight(graph.cooccurrence_pairs(told(s, d))))


def flat_store(spark: SparkSession, sf_dir: str):
    """All documents in one scope, with their entities and links."""
    from memloom.plans.search import Store

    flat = lambda s, d: stored(s, d, "flat_mentions", lambda s, d: mentions(s, d, flat_items))
    return Store(flat_embedded(spark, sf_dir), stored(spark, sf_dir, "flat_entities", lambda s, d: graph.entity_merge(flat(s, d))),
                 None, stored(spark, sf_dir, "flat_links", lambda s, d: graph.item_links(flat(s, d))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), "conv_id").alias("conversation_id"), "turn", "role", "text",
        F.concat(F.lit("t"), F.col("conv_id") % 2).alias("tenant"),
        F.concat(F.lit("u"), F.col("conv_id") % 3).alias("user_id"),
        F.concat(F.lit("p"), F.col("conv_id") % 5).alias("project"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("conversation_id", r"(\d+)", 1).cast("long")
    return messages(spark, sf_dir).groupBy("conversation_id", *SCOPE).agg(F.max("turn").alias("last")).select(
        "conversation_id", *SCOPE, F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("session_id"),
        F.timestamp_seconds(F.lit(EPOCH) + n * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH) + n * 60 + F.col("last") * 3600).alias("updated_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("conv_"), "user_id").alias("conversation_id"), F.col("event_id").alias("seq"), "ts",
        (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"),
        F.when(F.col("event_type") != "error", F.col("value") / 1000).alias("cost_usd"),
    )


def part_links(spark, sf_dir):
    def build(s, d):
        return table(s, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("entity_id")).distinct()

    return stored(spark, sf_dir, "part_links", build)


def part_edges(spark, sf_dir):
    """One edge per pair of parts ordered together (orders have few lines)."""
    def build(s, d):
        a = part_links(s, d)
        b = a.select("item_id", F.col("entity_id").alias("to_entity"))
        pairs = a.join(b, "item_id").where(F.col("entity_id") < F.col("to_entity"))
        return pairs.select(F.col("entity_id").alias("from_entity"), "to_entity").distinct()

    return stored(spark, sf_dir, "part_edges", build)


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of every assistant turn: init, 40-character deltas, a tool call, a result.

    Every third turn's server is down or mute, every seventh ends in an error and every
    eleventh holds a line that is not JSON.
    """
    base = messages(spark, sf_dir).where(F.col("role") == "assistant").withColumn(
        "n", F.regexp_extract("conversation_id", r"(\d+)", 1).cast("long") * 10 + F.col("turn")
    )
    n = F.col("n")
    status = F.when(n % 3 == 0, "failed").otherwise("connected")
    tools = F.when(n % 5 == 0, F.array(F.lit("Read"))).otherwise(F.array(F.lit("mcp__memory__memory_search"), F.lit("Read")))
    init = F.to_json(F.struct(
        F.lit("system").alias("type"), F.lit("init").alias("subtype"), F.concat(F.lit("s"), n).alias("session_id"),
        F.array(F.struct(F.lit("memory").alias("name"), status.alias("status"))).alias("mcp_servers"), tools.alias("tools"),
    ))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40)),
        lambda i: F.substring(F.col("text"), (i * 40 + 1).cast("int"), F.lit(40)),
    )
    deltas = F.transform(pieces, lambda t: F.to_json(F.struct(
        F.lit("content_block_delta").alias("type"),
        F.struct(F.lit("text_delta").alias("type"), t.alias("text")).alias("delta"),
    )))
    tool = F.when(n % 2 == 0, "mcp__memory__memory_search").otherwise("Read")
    start = F.to_json(F.struct(
        F.lit("content_block_start").alias("type"),
        F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), n).alias("id"), tool.alias("name")).alias("content_block"),
    ))
    body = F.concat(
        (n % 4).cast("string"), F.lit(" item(s) matched\n[item_"), n.cast("string"),
        F.lit("] (note, 2024-01-01, src=doc)\nfirst line\nsecond line\n\nrest"),
    )
    result_block = F.array(F.struct(
        F.lit("tool_result").alias("type"), F.concat(F.lit("t"), n).alias("tool_use_id"), body.alias("content"),
        (n % 9 == 0).alias("is_error"),
    ))
    told = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(result_block.alias("content")).alias("message")))
    said = F.to_json(F.struct(
        F.lit("assistant").alias("type"),
        F.struct(
            F.struct((n % 7).alias("input_tokens"), (n % 13).alias("output_tokens")).alias("usage"),
            F.lit("end_turn").alias("stop_reason"),
        ).alias("message"),
    ))
    done = F.to_json(F.struct(
        F.lit("result").alias("type"), (n % 7 == 0).alias("is_error"), F.col("text").alias("result"),
        (n % 50 / 100).alias("total_cost_usd"),
        F.when(n % 4 != 0, F.struct(F.floor(F.length("text") / 4).alias("input_tokens"), F.length("text").alias("output_tokens"))).alias("usage"),
    ))
    noise = F.when(n % 11 == 0, F.array(F.lit("warning: not json"), F.lit('{"type":"mystery"}'))).otherwise(F.array())
    # Every fourth turn streams nothing, so its text comes with the result.
    body_lines = F.when(n % 4 == 0, F.array()).otherwise(deltas)
    lines = F.concat(F.array(init), noise.cast("array<string>"), F.array(start, told), body_lines.cast("array<string>"), F.array(said, done))
    return base.select("conversation_id", "turn", F.posexplode(lines).alias("seq", "line")).withColumn(
        "seq", F.col("seq").cast("long")
    )


# --- the same shapes as SQL -------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _items_cte(name: str, scope: str, superseded: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""{name} AS (
SELECT 'item_' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS item_id, {scope},
  CASE d.doc_id % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'fact' WHEN 2 THEN 'preference'
    WHEN 3 THEN 'procedure' WHEN 4 THEN 'note' ELSE 'artifact' END AS type,
  d.text AS content, 'doc:' || d.source AS source,
  CAST(coalesce(0.5 + 0.5 * l.quality, 0.75) AS FLOAT) AS confidence,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE + (d.doc_id % 180) * INTERVAL 1 DAY AS updated_at,
  {superseded} AS superseded_by,
  CASE WHEN d.doc_id % 5 = 0 THEN 'conv_' || (d.doc_id % 100) END AS conversation_id, d.doc_id AS seq
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


ITEMS = _items_cte("items", "lang AS tenant, 'u' || (d.doc_id % 2) AS user_id, 'p' || (d.doc_id % 3) AS project")
FLAT = _items_cte("items", "'acme' AS tenant, 'u' AS user_id, 'p' AS project")
VERSIONS = _items_cte("base", "'acme' AS tenant, 'u' AS user_id, 'p' AS project") + """,
items AS (SELECT * REPLACE (CASE WHEN max(item_id) OVER (PARTITION BY content) <> item_id
  THEN max(item_id) OVER (PARTITION BY content) END AS superseded_by) FROM base)"""

QUERIES = """queries AS (
SELECT 'q' || item_id AS query_id, (['de', 'en', 'es', 'fr'])[item_id % 4 + 1] AS tenant,
  'u' || (item_id % 2) AS user_id, CASE WHEN item_id % 3 <> 0 THEN 'p' || (item_id % 3) END AS project, text AS query
FROM benchmark)"""
FLAT_QUERIES = """queries AS (
SELECT 'q' || item_id AS query_id, 'acme' AS tenant, 'u' AS user_id, CAST(NULL AS VARCHAR) AS project, text AS query
FROM benchmark)"""

IN_SCOPE = "i.tenant = q.tenant AND i.user_id = q.user_id AND (q.project IS NULL OR i.project = q.project)"


def vectors(source: str, key: str, text: str, out: str) -> str:
    """Sparse hashed unit vectors (key, bucket, w) in single precision."""
    return f"""{out}_tf AS (SELECT {key}, token, count(*) AS n FROM
  (SELECT {key}, unnest({tokens(text)}) AS token FROM {source}) GROUP BY ALL),
{out}_signs AS (SELECT {key}, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 384 AS bucket, n,
  sum(CASE WHEN CAST('0x' || substr(sha256(token), 10, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS signs FROM {out}_tf GROUP BY ALL),
{out}_raw AS (SELECT {key}, bucket, sum(signs * (1 + ln(n))) AS w FROM {out}_signs GROUP BY ALL),
{out}_len AS (SELECT {key}, sqrt(sum(w * w)) AS len FROM {out}_raw GROUP BY 1),
{out} AS (SELECT {key}, bucket, CAST(w / len AS FLOAT)::DOUBLE AS w FROM {out}_raw JOIN {out}_len USING ({key}) WHERE len > 0 AND w <> 0),
{out}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS len FROM {out} GROUP BY 1)"""


MENTIONS = ITEMS + """,
listed AS (SELECT tenant, user_id, project, item_id, seq,
  list_transform(list_filter(string_split_regex(content, '[^A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{5,}$')), lambda w: lower(w)) AS names FROM items),
exploded AS (SELECT tenant, user_id, project, item_id, seq, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM listed),
mentions AS (SELECT *, name AS name_norm, CASE WHEN length(name) % 3 = 0 THEN 'component' ELSE 'concept' END AS kind,
  'ent_' || substr(sha256(tenant || '/' || user_id || '/' || project || chr(0) || name || chr(0)), 1, 16) AS entity_id FROM exploded)"""
ENTITIES = """entities AS (SELECT tenant, user_id, project, entity_id, name_norm, arg_min(name, (seq, pos)) AS name,
  coalesce(arg_min(kind, (seq, pos)) FILTER (kind <> 'concept'), 'concept') AS kind FROM mentions GROUP BY ALL)"""
LINKS = "links AS (SELECT DISTINCT item_id, entity_id FROM mentions)"
PAIRS = """firsts AS (SELECT item_id, seq, entity_id, min(pos) AS pos FROM mentions GROUP BY ALL),
pairs AS (SELECT a.item_id, a.seq, a.entity_id AS from_entity, b.entity_id AS to_entity
  FROM firsts a JOIN firsts b ON a.item_id = b.item_id AND a.pos < b.pos)"""
RELATIONS = PAIRS + """,
relations AS (SELECT 'rel_' || substr(sha256(from_entity || chr(0) || to_entity || chr(0) || 'RELATES_TO' || chr(0)), 1, 16) AS rel_id,
  from_entity, to_entity, 'RELATES_TO' AS type, least(1.0 + 0.25 * (count(*) - 1), 5.0)::DOUBLE AS weight,
  arg_max(item_id, (seq, item_id)) AS evidence_item FROM pairs GROUP BY from_entity, to_entity)"""
GRAPH = ",\n".join([MENTIONS, ENTITIES, LINKS, RELATIONS])

MESSAGES = """messages AS (SELECT 'conv_' || conv_id AS conversation_id, conv_id, turn, role, text,
  't' || (conv_id % 2) AS tenant, 'u' || (conv_id % 3) AS user_id, 'p' || (conv_id % 5) AS project FROM conversations)"""
CONVS = MESSAGES + """,
convs AS (SELECT conversation_id, tenant, user_id, project,
  TIMESTAMP '2024-01-01 00:00:00' + min(conv_id) * INTERVAL 1 MINUTE AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + min(conv_id) * INTERVAL 1 MINUTE + max(turn) * INTERVAL 1 HOUR AS updated_at
  FROM messages GROUP BY conversation_id, tenant, user_id, project)"""
USAGE = """usage AS (SELECT 'conv_' || user_id AS conversation_id, event_id AS seq, ts, event_id % 1000 AS input_tokens,
  event_id % 300 AS output_tokens, CASE WHEN event_type <> 'error' THEN value / 1000 END AS cost_usd FROM events)"""
EDGES = """part_links AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS entity_id FROM lineitem),
part_edges AS (SELECT DISTINCT a.entity_id AS from_entity, b.entity_id AS to_entity
  FROM part_links a JOIN part_links b ON a.item_id = b.item_id AND a.entity_id < b.entity_id)"""
