"""Search by way of pivots says what the search of all pairs says, and compares less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import knn

SCHEMA = "item_id string, tenant string, user_id string, project string, type string, embedding array<float>, superseded_by string, seq long"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, scattered rows, exact copies and vectors of length zero, in a large and a small scope."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    near = centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 24)) * 0.08
    rows = np.concatenate([near, rng.normal(size=(200, 24)), near[:60], np.zeros((12, 24))])
    data = [(f"i{n:05d}", "t", "u", "p" if n % 40 else "q", "note" if n % 3 else "fact", [float(x) for x in v], None, n)
            for n, v in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3).persist()


def both(monkeypatch, run):
    monkeypatch.setattr(knn.blocked_similarity, "__defaults__", (None, None, knn.BLOCK_ROWS, False, 10**9))
    plain = sorted(map(str, run().collect()))
    monkeypatch.setattr(knn.blocked_similarity, "__defaults__", (None, None, knn.BLOCK_ROWS, False, 2))
    assert sorted(map(str, run().collect())) == plain
    return plain


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_rows_are_the_same(vectors, monkeypatch, k):
    asked = vectors.select(F.col("item_id").alias("query_id"), "tenant", "user_id", "project", F.col("embedding").alias("vector"),
                           F.when(F.col("seq") % 5 == 0, F.array(F.lit("fact"))).otherwise(F.array().cast("array<string>")).alias("types"))
    # A query without a project spans both.
    asked = asked.withColumn("project", F.when(F.col("query_id").endswith("7"), None).otherwise(F.col("project")))
    got = both(monkeypatch, lambda: knn.knn_join(asked, vectors, k, block_rows=128).select("query_id", "item_id", F.round("score", 8), "rank"))
    assert len(got) > 1000


def test_near_duplicates_are_the_same(vectors, monkeypatch):
    got = both(monkeypatch, lambda: knn.near_dup_join(vectors, 0.93, block_rows=128).select("item_id", "match_id", F.round("score", 8)))
    assert len(got) > 800


def test_far_homes_are_left_out(vectors):
    left = vectors.select(F.col("item_id").alias("query_id"), "tenant", "user_id", "project", F.col("embedding").alias("vector"))
    right = vectors.select("item_id", "tenant", "user_id", "project", F.col("embedding").alias("vector"))
    share = knn.compared_share(left, right, 1, 0.93, block_rows=128).first()
    assert share["pairs"] == vectors.groupBy("project").count().agg(F.sum(F.col("count") ** 2)).first()[0]
    assert share["compared"] < 0.35 * share["pairs"]


def test_scopes_without_direction(spark):
    rows = [(f"i{n}", "t", "u", "p", "note", [0.0] * 4, None, n) for n in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("item_id").alias("query_id"), "tenant", "user_id", "project", F.col("embedding").alias("vector"))
    right = df.select("item_id", "tenant", "user_id", "project", F.col("embedding").alias("vector"))
    got = knn.topk_per_query(knn.blocked_similarity(asked, right, 2, block_rows=3, pivot_blocks=2), 2).collect()
    assert {(r["query_id"], r["item_id"], r["score"]) for r in got} == {(f"i{n}", i, 0.0) for n in range(9) for i in ("i0", "i1")}


def _grown(spark, copies):
    """Groups of `copies` near copies and as many scattered rows, in one scope."""
    rng = np.random.default_rng(11)
    near = rng.normal(size=(4, 1, 160)) + rng.normal(size=(4, copies, 160)) * 0.15
    rows = np.concatenate([near.reshape(-1, 160), rng.normal(size=(4 * copies, 160))])
    data = [(f"i{n:05d}", "t", "u", "p", "note", [float(x) for x in v], None, n) for n, v in enumerate(rows[rng.permutation(len(rows))])]
    return spark.createDataFrame(data, SCHEMA).repartition(3).persist()


@pytest.mark.parametrize("copies", [20, 120])
def test_sketches_find_what_all_pairs_find(spark, monkeypatch, copies):
    rows = _grown(spark, copies)
    got = both(monkeypatch, lambda: knn.near_dup_join(rows, 0.93, block_rows=64).select("item_id", "match_id", F.round("score", 8)))
    assert len(got) >= 4 * (copies - 1)


def test_vectors_are_not_copied_to_every_block(spark, monkeypatch):
    """Only crowded rows meet block by block; of all others no vector is dealt to a block."""
    dealt, plain = [], knn._compare

    def compare(l, r, *more):
        dealt.append(l.count() + r.count())
        return plain(l, r, *more)

    monkeypatch.setattr(knn, "_compare", compare)
    rows = _grown(spark, 20)
    assert knn.near_dup_join(rows, 0.93, block_rows=8).count() >= 76
    assert sum(dealt) == 0
