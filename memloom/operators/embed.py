"""Signed-hash bag-of-words embeddings and the seam for other embedders."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import STOPWORDS, normalize_text, tokens_of_normalized
from memloom.schemas import EMBEDDING_DIMS

HASH_MODEL = "hash-v1"
Embedder = Callable[[DataFrame], DataFrame]
#: Rows and tokens of a batch that are weighed at once.
_ROWS, _TOKENS = 1024, 1 << 20


def token_bucket(token: Column, dims: int = EMBEDDING_DIMS) -> Column:
    """Bucket of a token: the first four digest bytes, big endian, modulo dims."""
    head = F.substring(F.sha2(token, 256), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % dims).cast("int")


def token_sign(token: Column) -> Column:
    """Sign of a token: the lowest bit of the fifth digest byte."""
    digit = F.conv(F.substring(F.sha2(token, 256), 10, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 0, 1.0).otherwise(-1.0)


def token_counts(df: DataFrame, text: str, keys: list[str], wanted: DataFrame | None = None, together: str | None = None, parts: int | None = None) -> DataFrame:
    """(keys, token, tf) for every distinct token, or only for the wanted ones; one shuffle at most.

    `together` names a key whose rows are to lie in one partition, of `parts` where a number is given.
    """
    words = df.select(*keys, F.explode(F.split(normalize_text(F.col(text)), " ")).alias("token"))
    syllable = F.col("token").rlike(r"^[\x{ac00}-\x{d7a3}]$")
    kept = words.where(
        ((F.length("token") > 1) | syllable) & ~F.col("token").isin(STOPWORDS)
    )
    if wanted is not None:
        kept = kept.join(wanted.select("token").distinct(), "token", "left_semi")
    if together is not None:
        kept = kept.repartition(*([parts] if parts else []), together)
    return kept.groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def _weight_of_count():
    @F.arrow_udf("double")
    def weigh(tf: pa.Array) -> pa.Array:
        return pa.array(count_weights(tf.to_numpy(zero_copy_only=False)))

    return weigh


def sparse_embedding(df: DataFrame, text: str, key: str, dims: int = EMBEDDING_DIMS) -> DataFrame:
    """(key, bucket, w) of the unit vector, with the non-zero buckets only."""
    # Counted before any shuffle; partitioned by key, the steps after it need none.
    counts = token_counts(df, text, [key]).repartition(key)
    signs = counts.groupBy(key, token_bucket(F.col("token"), dims).alias("bucket"), "tf").agg(
        F.sum(token_sign(F.col("token")).cast("int")).alias("signs"))
    # Signs add up exactly, so tokens that cancel leave no residue; tf order fixes the rounding.
    weighed = signs.select(key, "bucket", "tf", (F.col("signs") * _weight_of_count()(F.col("tf"))).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("tf", "part")))
    weight = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["part"])
    buckets = weighed.groupBy(key, "bucket").agg(weight.alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return buckets.select(key, "bucket", (F.col("w") / norm).alias("w"))


def dense_vector(sparse: DataFrame, key: str, dims: int = EMBEDDING_DIMS) -> DataFrame:
    """Sparse rows to one array<float> per key."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "w")))
    grouped = sparse.groupBy(key).agg(entries.alias("_w"))
    at = lambda i: F.coalesce(F.element_at(F.col("_w"), i), F.lit(0.0)).cast("float")
    return grouped.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at).alias("embedding"))


@lru_cache(maxsize=1 << 18)
def _placement(token: str, dims: int) -> tuple[int, int]:
    digest = hashlib.sha256(token.encode("utf-8")).digest()
    return int.from_bytes(digest[:4], "big") % dims, -1 if digest[4] & 1 else 1


def count_weights(tf: np.ndarray) -> np.ndarray:
    """1 + ln(tf) with the C library's logarithm: those of the JVM and of numpy differ from it in the last bit."""
    distinct, at = np.unique(tf, return_inverse=True)
    return np.array([1.0 + math.log(n) for n in distinct.tolist()], dtype=np.float64)[at.ravel()]


def _unit_vectors(lists: pa.ListArray, dims: int) -> np.ndarray:
    words = lists.flatten().dictionary_encode()
    placed = [_placement(w, dims) for w in words.dictionary.to_pylist()]
    bucket, sign = np.array([b for b, _ in placed], dtype=np.int64), np.array([s for _, s in placed], dtype=np.int64)
    row = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if not len(row):
        return np.zeros((len(lists), dims), np.float32)
    # Term counts per row, then signs per (row, bucket, count): sums of whole numbers, so what cancels is gone.
    pair, tf = np.unique(row * len(placed) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    held, word = np.divmod(pair, len(placed))
    wide = int(tf.max()) + 1
    cell, at = np.unique((held * dims + bucket[word]) * wide + tf, return_inverse=True)
    signs = np.bincount(at.ravel(), weights=sign[word], minlength=len(cell))
    place, count = np.divmod(cell, wide)
    vectors = np.bincount(place, weights=signs * count_weights(count), minlength=len(lists) * dims).reshape(len(lists), dims)
    lengths = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, lengths, out=vectors, where=lengths > 0).astype(np.float32)


def _slices(lengths: np.ndarray, rows: int = _ROWS, tokens: int = _TOKENS) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of few rows and few tokens; a row of more tokens is one of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (i - start >= rows or held + n > tokens):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def token_lists():
    """Arrow-batched token array to its distinct tokens and their counts: row-local."""

    @F.arrow_udf("struct<token:array<string>,tf:array<int>>")
    def count(tokens: pa.Array) -> pa.Array:
        lists = tokens.fill_null([])
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends, words, counts = [np.zeros(1, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for start, n in _slices(lengths):
            part = lists.slice(start, n)
            coded = part.flatten().dictionary_encode()
            row = np.repeat(np.arange(n, dtype=np.int64), lengths[start:start + n])
            pair, tf = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            held, word = np.divmod(pair, max(1, len(coded.dictionary)))
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(held, minlength=n)))
            words.append(coded.dictionary.take(pa.array(word)))
            counts.append(tf)
        offsets = pa.array(np.concatenate(ends).astype(np.int32))
        token = pa.ListArray.from_arrays(offsets, pa.concat_arrays(words))
        tf = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts).astype(np.int32)))
        return pa.StructArray.from_arrays([token, tf], ["token", "tf"])

    return count


def hash_vector(dims: int = EMBEDDING_DIMS):
    """Arrow-batched token array to unit vector: row-local, so no shuffle of the text.

    A batch is taken in stretches of bounded size and its words never become Python objects one by one.
    """

    @F.arrow_udf("array<float>")
    def embed(tokens: pa.Array) -> pa.Array:
        lists = tokens.fill_null([])
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        parts = [_unit_vectors(lists.slice(start, n), dims).ravel() for start, n in _slices(lengths)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dims), pa.array(flat))

    return embed


def hash_embedder(text: str = "content", dims: int = EMBEDDING_DIMS, output: str = "embedding") -> Embedder:
    """The default embedder: tokens on the JVM, the weighted hash in one Arrow pass."""
    vector = hash_vector(dims)

    def embed(df: DataFrame) -> DataFrame:
        tokens = tokens_of_normalized(normalize_text(F.col(text)))
        return df.withColumn(output, vector(tokens))

    return embed


def model_embedder(
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    dims: int,
    text: str = "content",
    output: str = "embedding",
) -> Embedder:
    """Plug in a model: `load` runs once per worker task, then embeds whole Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            vectors = model(batch.tolist())
            wrong = next((len(v) for v in vectors if len(v) != dims), None)
            if wrong is not None:
                raise ValueError(f"expected {dims} dimensions, got {wrong}")
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors])

    return lambda df: df.withColumn(output, embed(F.col(text)))


def mean_pool(token_vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean over a key's token vectors, position by position."""
    cells = token_vectors.select(key, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda c: c["x"]).alias("embedding"))
