"""Documents whose word n-gram sets are alike (Jaccard), joined by prefix tokens and tries.

Tokens are ordered by how many n-grams share their hashed count, then by hash, so common passages come
last. Two sets that are alike enough share a token among their first ones. Equal sets are one. First,
sets meet in the blocks of three of their shared tokens, where a trie finds their classes; a block that
is too large is dealt into several. What this may miss is then completed exactly: tokens
shared across classes give candidate pairs, bounds on size, place and shared prefix thin them, and a
trie of a set's partners decides. Pairs inside one class are never listed, so a group of copies costs
what its members cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm import bitmap, trie
from memloom.llm.columns import set_aside
from memloom.llm.components import components
from memloom.llm.flat import NON_SPACE, flatten, mix, pieces, span_hash, word_bounds
from memloom.session import cut_lineage

COUNT_BITS = 18
BLOCK = 2048


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n-grams per text), repeats included; a text of fewer words has all of them as one."""
    data, offsets = flatten(texts)
    starts, ends, counts = word_bounds(data, offsets, NON_SPACE)
    words = span_hash(data)(starts, ends)
    first = np.cumsum(counts) - counts
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    end = np.repeat(first + counts, grams)
    total = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(n, np.uint64))
    for k in range(n):
        inside = at + k < end
        with np.errstate(over="ignore"):
            total = mix(total + np.where(inside, padded[at + k], np.uint64(0))) + inside.astype(np.uint64) * np.uint64(k + 1)
    return mix(total), grams


def token_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many n-grams of all texts fall into each of 2^COUNT_BITS hash buckets: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                hashes, _ = shingle_hashes(piece.column(0), n)
                counts += np.bincount((hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def rank_of_buckets(counts: np.ndarray) -> np.ndarray:
    """0 for the usual bucket, else one more for each half doubling of what it holds beyond chance.

    Chance is the median and twice the spread about it, so an n-gram that a few dozen documents share shows
    in a table of a hundred thousand, and one of a millionth of all documents in any.
    """
    middle = np.median(counts)
    spread = max(np.sqrt(max(middle, 1.0)), 1.4826 * np.median(np.abs(counts - middle)))
    beyond = np.maximum(counts - middle - 2 * spread, 0)
    return np.clip(np.where(beyond > 0, 1 + np.floor(2 * np.log2(1 + beyond)), 0), 0, 63).astype(np.uint64)


def ordered_sets(texts: pa.Array, n: int, ranks: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct tokens in global order: the bucket's rank above 58 bits of hash."""
    hashes, grams = shingle_hashes(texts, n)
    tokens = (ranks[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] << np.uint64(58)) | (hashes & np.uint64((1 << 58) - 1))
    ends = np.cumsum(grams)
    out = []
    for low, high in zip(ends - grams, ends):
        one = np.sort(tokens[low:high])
        out.append(one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one)
    return out


def set_table(docs: DataFrame, n: int, part: int, whole: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, m (set size), two hashes of the set, and its prefix: the first tokens, of which alike sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = ordered_sets(piece.column(1), n, ranks)
                m = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    marks = [np.array([int(mix(s + np.uint64(salt)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                heads = [s[:len(s) + part * len(s) // -whole + 1 if len(s) else 0] for s in sets]
                bounds = np.cumsum([0] + [len(h) for h in heads])
                flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(m), pa.array(marks[0]), pa.array(marks[1]),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["doc_id", "m", "f1", "f2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, m long, f1 long, f2 long, prefix array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, n: int, ranks: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Runs of rows (key columns, id, text) alike in the keys, as lists of (id, set)."""
    now, held = None, []
    for batch in batches:
        for piece in pieces(batch):
            columns = [piece.column(i).to_pylist() for i in range(keys + 1)]
            for *key, id_, tokens in zip(*columns, ordered_sets(piece.column(keys + 1), n, ranks)):
                if key != now:
                    if held:
                        yield held
                    now, held = key, []
                held.append((id_, tokens))
    if held:
        yield held


def _block_edges(blocks: DataFrame, texts: DataFrame, n: int, part: int, whole: int, ranks: np.ndarray) -> DataFrame:
    """Edges (a, b) that connect what is linked inside each block (token, chunk, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2, n, ranks):
            if len(group) > 1:
                label = trie.classes([tokens for _, tokens in group], part, whole)
                edges = [(group[i][0], group[j][0]) for i, j in enumerate(label) if group[i][0] != group[j][0]]
                if edges:
                    a, b = zip(*edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = blocks.join(texts, "id").repartition("token", "chunk").sortWithinPartitions("token", "chunk", "id")
    return rows.select("token", "chunk", "id", "text").mapInArrow(run, "a long, b long")


def _pair_edges(pairs: DataFrame, texts: DataFrame, n: int, part: int, whole: int, ranks: np.ndarray) -> DataFrame:
    """The pairs (a, b) that are linked. A set's partners pass by in tries of at most BLOCK."""

    def flush(query: list, partners: list) -> list[tuple[int, int]]:
        found = []
        for own in query:
            together = [own[1], *(tokens for _, tokens in partners)]
            search = trie.Trie(together)
            hits = search.near(search.order.index(0), part, whole, after=False)
            found += [(own[0], partners[search.order[h] - 1][0]) for h in hits]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, partners = None, [], []

        def answer() -> Iterator[pa.RecordBatch]:
            edges = flush(query, partners) if partners else []
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for piece in pieces(batch):
                keys, others, ids = (piece.column(i).to_pylist() for i in range(3))
                for key, other, id_, tokens in zip(keys, others, ids, ordered_sets(piece.column(3), n, ranks)):
                    if key != now or len(partners) >= BLOCK:
                        yield from answer()
                        partners = []
                        if key != now:
                            now, query = key, []
                    (partners if other else query).append((id_, tokens))
        yield from answer()

    asked = pairs.select("a", F.lit(1).alias("other"), F.col("b").alias("id")).unionByName(
        pairs.select("a", F.lit(0).alias("other"), F.col("a").alias("id")).distinct())
    rows = asked.join(texts, "id").repartition("a").sortWithinPartitions("a", "other", "id")
    return rows.select("a", "other", "id", "text").mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id that links lead to.

    Sets are of n-word shingles (A to Z lower-cased); two link when whole * intersection >= part * union.
    Rows without words have an empty set and stand alone, as do rows of null doc_id (component null). Rows
    that repeat a doc_id are one document: a link of any of them is one of all.
    """
    ranks = rank_of_buckets(token_counts(docs, n))
    sets = cut_lineage(set_table(docs, n, part, whole, ranks), "jaccard-sets")
    own = sets.where((F.col("m") > 0) & F.col("doc_id").isNotNull())
    first = cut_lineage(own.groupBy("f1", "f2", "m").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "jaccard-firsts")
    copies = own.select("doc_id", "f1", "f2", "m").join(first.where("n > 1"), ["f1", "f2", "m"]).select(
        F.col("doc_id").alias("a"), F.col("id").alias("b")).where(F.col("a") != F.col("b"))
    heads = own.join(first.select("f1", "f2", "m", F.col("id").alias("doc_id")), ["f1", "f2", "m", "doc_id"], "left_semi")
    tokens = heads.select(F.col("doc_id").alias("id"), F.col("m").cast("int").alias("m"), F.posexplode("prefix").alias("pos", "token"))
    of_token = Window.partitionBy("token")
    shared = tokens.withColumns({"_low": F.min("id").over(of_token), "_high": F.max("id").over(of_token), "n": F.count("*").over(of_token)})
    shared = cut_lineage(shared.where("_low < _high").drop("_low", "_high"), "jaccard-shared")

    chunk = F.pmod(F.xxhash64("token", "id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    # Of its shared tokens a set takes its first, its most common one, and the least under a hash: pairs of copies
    # meet by the first, large groups by the second, and the third, in which like sets mostly agree, ties groups together.
    place = F.struct("token", chunk.alias("chunk"))
    orders = [F.col("pos"), -F.col("n"), F.xxhash64("token")]
    taken = shared.groupBy("id").agg(F.array_distinct(F.array(*[F.min_by(place, F.struct(o, "token")) for o in orders])).alias("places"))
    taken = cut_lineage(taken, "jaccard-places")
    blocks = taken.select("id", F.inline("places"))
    texts = bitmap.only(docs.select(F.col("doc_id").alias("id"), "text"), "id", taken.select("id"))
    within = cut_lineage(_block_edges(blocks, texts, n, part, whole, ranks), "jaccard-blocks")
    known = components(copies.unionByName(within), "jaccard-classes")

    # What is left: tokens that two classes share.
    classed = shared.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component", "n")
    mixed = classed.withColumns({"_low": F.min("class").over(of_token), "_high": F.max("class").over(of_token)}).where("_low < _high").drop("_low", "_high")
    mixed = cut_lineage(mixed, "jaccard-mixed")
    # Only tokens that other classes have too can be common to sets of two classes: seen counts those before a token.
    mixed = mixed.withColumn("seen", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).join(taken, "id")
    side = lambda s: mixed.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "m", "pos", "class", "seen", "places")])
    a, b = side("a"), side("b")
    need = F.ceil((F.col("m_a") + F.col("m_b")) * part / (part + whole))
    pairs = a.join(b, "token").where(
        # Sets of two classes that met in a block were compared there.
        (F.col("class_a") != F.col("class_b")) & ~F.arrays_overlap("places_a", "places_b") & (F.struct("m_a", "id_a") < F.struct(F.col("m_b").alias("m_a"), F.col("id_b").alias("id_a")))
        & (F.col("m_a") * whole >= F.col("m_b") * part)
        & (F.least("seen_a", "seen_b") + F.least(F.col("m_a") - F.col("pos_a"), F.col("m_b") - F.col("pos_b")) >= need))
    rest = lambda s: F.ceil(F.col(f"m_{s}") * part / whole) - 1  # tokens behind the prefix
    counted = pairs.groupBy("id_a", "id_b", "m_a", "m_b").agg(
        F.count("*").alias("k"), F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b")).where(
        (F.col("k") + F.greatest(rest("a"), rest("b")) >= need)
        & (F.least(F.col("m_a") - F.col("pos_a"), F.col("m_b") - F.col("pos_b")) >= need))
    pairs = cut_lineage(counted.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "jaccard-pairs")
    across = _pair_edges(pairs, bitmap.only(docs.select(F.col("doc_id").alias("id"), "text"), "id", pairs.select(
        F.explode(F.array("a", "b")).alias("id")).distinct()), n, part, whole, ranks)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across), "jaccard-final")
    return sets.select("doc_id", F.col("m").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of `docs` that lead their class, all columns kept; of rows that repeat a kept doc_id the one
    of the least text stays, and of equal texts the least by all columns as JSON, so that reruns agree.

    Rows of null doc_id cannot be named by a link and stay.
    """
    docs, names = set_aside(docs, ["doc_id", "text"])
    found = cut_lineage(jaccard_classes(docs, n, part, whole), "jaccard-result")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = bitmap.without(docs, "doc_id", gone)
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept.toDF(*names)
    row = F.struct(*docs.columns)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row")).select("_row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once).toDF(*names)
