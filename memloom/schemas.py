"""Explicit schemas of the stored tables and shared constants."""

from pyspark.sql import types as T

SCOPE = ["tenant", "user_id", "project"]

# Item types and their ranking weights (divided by 10 when scored).
TYPE_WEIGHTS = {
    "decision": 10,
    "preference": 8,
    "procedure": 7,
    "fact": 6,
    "artifact": 3,
    "note": 2,
}
MEMORY_TYPES = list(TYPE_WEIGHTS)

RELATION_TYPES = [
    "RELATES_TO", "DEPENDS_ON", "PART_OF", "CONTRADICTS", "SUPERSEDES", "MENTIONS",
]

# Fusion weights per branch and the rank constant.
BRANCH_WEIGHTS = {"vector": 1.0, "fts": 0.9, "graph": 0.6}
RRF_K = 60

EMBEDDING_DIMS = 384
DEDUPE_THRESHOLD = 0.93

ITEM = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("tenant", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("project", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("confidence", T.FloatType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("superseded_by", T.StringType(), True),
    T.StructField("conversation_id", T.StringType(), True),
    T.StructField("embedding_model", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("tenant", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("project", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("name_norm", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

RELATION = T.StructType([
    T.StructField("rel_id", T.StringType(), False),
    T.StructField("from_entity", T.StringType(), False),
    T.StructField("to_entity", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("evidence_item", T.StringType(), True),
])

_USAGE = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
])

# One line of a model's event stream. Content is polymorphic (text or a list of
# blocks), so it stays a JSON string and is parsed where it is used.
EVENT_LINE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("subtype", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("usage", _USAGE),
    ])),
    T.StructField("delta", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
    ])),
    T.StructField("content_block", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("input", T.StringType()),
    ])),
    T.StructField("mcp_servers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
    ]))),
    T.StructField("tools", T.ArrayType(T.StringType())),
    T.StructField("result", T.StringType()),
    T.StructField("is_error", T.BooleanType()),
    T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("usage", _USAGE),
])

EVENT_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("tool_use_id", T.StringType()),
    T.StructField("is_error", T.BooleanType()),
    T.StructField("content", T.StringType()),
]))

TURNS = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))
