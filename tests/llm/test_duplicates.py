"""Jaccard join, vector passes and components: against brute force, groups of copies, and odd tables."""

import random

import numpy as np
import pytest

from memloom.llm import jaccard, trie, vectors
from memloom.llm.components import components
from tests.llm import brute


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute.components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(df.where("false")).collect() == []


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 5000, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.permutation(base)[:rng.integers(40, len(base))], rng.integers(5000, 6000, rng.integers(0, 8)).astype(np.uint64)))) for _ in range(60)]
    sets += [base, base, np.array([1], np.uint64), base[:5]]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    want = brute.components(range(len(sets)), edges)
    got = trie.classes(sets, 80, 100)
    assert brute.components(range(len(sets)), enumerate(got.tolist())) == want
    search = trie.Trie(sets)
    for q in range(len(sets)):
        near = sorted(search.order[p] for p in search.near(q, 80, 100, after=False))
        at = search.order[q]
        assert near == sorted({a + b - at for a, b in edges if at in (a, b)})


def family(seed, n, words=120):
    """A text, copies of it, and near copies with one to eight words changed."""
    random.seed(seed)
    base = [f"t{seed}w{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 9):
            w[random.randrange(words)] = f"e{random.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,part", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, part, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # blocks overflow, so links across them are completed
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [t for s in range(5) for t in family(s, 30)] + [f"{passage} own{i} " + " ".join(f"o{i}x{j}" for j in range(9)) for i in range(25)]
    random.seed(1)
    rows = list(enumerate(random.sample(texts, len(texts)), 100))
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, part).collect()}
    want = brute.jaccard_components(rows, n, part)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(brute.shingles(t, n)) for i, t in rows)


def test_jaccard_of_odd_rows(spark, odd, odd_rows, none):
    got = jaccard.jaccard_classes(odd, 4, 85).collect()
    assert len(got) == len(odd_rows)
    want = brute.jaccard_components([(r[0], r[1]) for r in odd_rows], 4, 85)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert jaccard.jaccard_classes(none).collect() == [] and jaccard.keep_one(none).collect() == []
    kept = jaccard.keep_one(odd, 4, 85)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({v for v in want.values()})
    assert kept.where("doc_id IS NULL").count() == 2


def test_keep_one_of_a_repeated_id_is_the_same_in_any_order(spark):
    texts = [f"text {chr(97 + i)} of its own" for i in range(12)]
    for order in (texts, texts[::-1]):
        rows = [(i % 3, t, n) for i in range(3) for t in order for n in ((2, 1) if order is texts else (1, 2))]
        kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1))
        assert sorted(tuple(r) for r in kept.collect()) == [(0, texts[0], 1)] and kept.columns == ["doc_id", "text", "extra"]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * 0.04 * (i % 5)).astype(np.float32).tolist() for i in range(25)]
    rows = [(i, v, None if i % 40 == 7 else i % 2) for i, v in enumerate(rows)]
    odd = [[0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0], []]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (2002, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    edges = [(a, b) for n, (a, x, k) in enumerate(good) for b, y, m in good[:n]
             if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    links = brute.components({r[0] for r in rows}, edges)
    degree = {i: 0 for i in links}
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == links and {k: r["n_links"] for k, r in got.items()} == degree
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_windows_grow_with_a_group():
    rng = np.random.default_rng(9)
    x = rng.normal(size=8) + rng.normal(size=(700, 8)) * 0.001
    i, j = vectors.window_links(x, 0.98)
    assert len(i) == 700 * 699 // 2


@pytest.mark.parametrize("partitions", [4, 200])
def test_vector_windows_cross_partitions(spark, partitions):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1600, 16))
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 0.03  # five blocks a pass wide, and more than several of 200 partitions
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cosine = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    near = (cosine >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert near[:1000].sum() > 900 * 999
    want = brute.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a > b])
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, value in conf.items():
            spark.conf.set(k, value)
        got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert {k: r["n_links"] for k, r in got.items()} == dict(enumerate(near.sum(1).tolist()))
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_vectors_of_any_magnitude(spark):
    """Components near the ends of the doubles' range, null and repeated ids, clashing columns."""
    rows = [(1, [1e200, 2e200, 1e198]), (2, [2e200, 4e200, 1e198]), (3, [1e-200, 2e-200, 1e-202]), (4, [5e-324, 0.0, 0.0]), (5, [1.7e308, 0.0, 0.0]),
            (None, [1.0, 2.0, 0.01]), (None, None), (6, [1.0, 0.0, 1e-300]), (6, [0.0, 0.0, 3.0]), (7, [-1e200, -2e200, 0.0])]
    df = spark.createDataFrame([(i, 0, v, 1, 2, 3, 4, 5) for i, v in rows],
                               "vec_id long, label int, embedding array<double>, a int, b int, n int, pass int, number int").repartition(3)
    got = sorted(((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()), key=str)
    # The three multiples of (1, 2, 0), and the rows without an id that link with them; those along the first axis.
    by = {i: (n, c) for i, n, c in got}
    assert by["1"][1] == by["2"][1] == by["3"][1] == 1 and by["1"][0] >= 2
    assert by["4"] == by["5"] and by["4"][1] == 4 and by["7"] == (0, 7)
    assert len(got) == len(rows)
