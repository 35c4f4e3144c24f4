"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_ring_shards")
def op3_ring_shards(spark, sf_dir):
    from memloom.llm.ring import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4_pii(spark, sf_dir):
    from memloom.llm import pii

    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op7_secrets")
def op7_secrets(spark, sf_dir):
    from memloom.llm import secrets

    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    from memloom.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public word-level vocabulary lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe")
def op8_bpe(spark, sf_dir):
    from memloom.llm.bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    from memloom.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    from memloom.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_language")
def op1_language(spark, sf_dir):
    from memloom.llm.language import language_report

    return language_report(table(spark, sf_dir, "documents"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    from memloom.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), n=4, part=85)


@query("op2_vector_dedup")
def op2_vector_dedup(spark, sf_dir):
    from memloom.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    import public_tokenizers

    from memloom.llm.align import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_token_counts")
def op12_token_counts(spark, sf_dir):
    from memloom.llm.counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def clustering_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The same rounds in DuckDB; components must be small enough for its integers."""
    parts = [f"""
    q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims}),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
      SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM q ORDER BY h, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""
    a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT q.r, c.c,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM q, c{n} AS c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
    s{n} AS MATERIALIZED (SELECT m.c AS c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (
        SELECT a{n}.m, unnest(q.v) AS x, unnest(range({dims})) AS i FROM a{n} JOIN q USING (r)) GROUP BY m.c, i),
    c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(t.v, c.v) AS v FROM c{n} AS c LEFT JOIN (
        SELECT c, list(x ORDER BY i) AS v FROM s{n} GROUP BY c) AS t ON t.c = c.c)""")
    return f"""WITH {','.join(parts)}
    SELECT q.vec_id, a.m.c AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN q USING (r) JOIN c{rounds} AS c ON c.c = a.m.c"""


@query("op13_centroids", clustering_sql())
def op13_centroids(spark, sf_dir):
    from memloom.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))
