"""Centroid clustering against a plain replay in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from memloom.llm import centroids
from memloom.llm.queries import QUERIES, clustering_sql


def replay(rows, k=16, rounds=3, dims=64):
    kept = [(i, tuple(math.floor(Fraction(x) * 64) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda v: min((distance(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(find(v)[1], []).append(v)
        means = [tuple(sum(x) // len(members[c]) for x in zip(*members[c])) if c in members else m for c, m in enumerate(means)]
    found = [(i, *find(v)) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    by = {c: sum(d for _, d, e in found if e == c) for c in range(len(means))}
    sha = lambda m: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()
    return sorted((str(i), c, str(fits(d)), str(fits(by[c])), str(fits(sum(by.values()))), sha(means[c])) for i, d, c in found)


def told(df):
    return sorted((str(r[0]), r[1], str(r[2]), str(r[3]), str(r[4]), r[5]) for r in df.collect())


def test_equals_the_replay_and_the_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = told(QUERIES["op13_centroids"](spark, sf_dir))
    assert got == replay([(r["vec_id"], r["embedding"]) for r in df.collect()])
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
        assert sorted((str(r[0]), r[1], *map(str, r[2:5]), r[5]) for r in db.execute(clustering_sql()).fetchall()) == got


def test_odd_vectors(spark):
    rng = random.Random(2)
    point = lambda s=1.0: [rng.gauss(0, s) for _ in range(64)]
    rows = [(i, point()) for i in range(60)] + [(i, [0.0] * 64) for i in range(60, 70)] + [(None, point()), (None, None), (70, None)]
    rows += [(71, point()[:63]), (72, [*point()[:63], None]), (73, [*point()[:63], float("nan")]), (74, [*point()[:63], float("inf")]), (75, [])]
    rows += [(5, rows[5][1])] * 3 + [(5, point())]
    schema = "vec_id long, embedding array<double>, label int, cluster string, v int"
    table = lambda some: spark.createDataFrame([(i, v, None, "x", 1) for i, v in some], schema).repartition(3)
    assert told(centroids.cluster_vectors(table(rows))) == replay(rows)
    huge = rows + [(80, [1e200, *point()[:63]]), (81, [-1.7e308] * 64), (82, [3e9] * 64), (83, [5e-324] * 64)]
    assert told(centroids.cluster_vectors(table(huge))) == replay(huge)
    few = rows[:3]
    assert told(centroids.cluster_vectors(table(few))) == replay(few)
    assert centroids.cluster_vectors(table([])).collect() == []


@pytest.mark.parametrize("spread", [2, 40, 100_000])
def test_searches_find_the_nearest_and_the_smaller_number(spread):
    rng = np.random.default_rng(spread)
    means = [tuple(map(int, m)) for m in rng.integers(-spread, spread, (16, 6))]
    means[9] = means[4]
    nodes = centroids.build_tree(means)
    vectors = np.concatenate((rng.integers(-spread, spread, (500, 6)), np.array(means)))
    want = [min((sum((x - y) ** 2 for x, y in zip(map(int, v), m)), c) for c, m in enumerate(means)) for v in vectors]
    cluster, distance = centroids.nearest(nodes, np.array(means), vectors)
    assert list(zip(distance.tolist(), cluster.tolist())) == want
    assert [centroids.nearest_one(nodes, means, tuple(map(int, v)))[::-1] for v in vectors] == want


def test_whole_branches_are_left_out(monkeypatch):
    means = [(1000 * c, 0) for c in range(16)]
    nodes, seen = centroids.build_tree(means), []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: (seen.append(len(a[1])), real(*a))[1])
    centroids.nearest(nodes, np.array(means), np.array([(7, 3)] * 100))
    assert sum(seen) < 100 * 8
