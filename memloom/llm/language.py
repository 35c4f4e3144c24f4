"""Language of whole texts by a linear-chain conditional random field over their words.

A word's features are its first and last bytes, its byte n-grams, itself, and what a lexicon of the
training words says about it; transitions between the languages of neighbouring words are learned with
the rest. Forward-backward gives each word's marginals, and a text takes the language with the greatest
share of its words. The recursions of all texts of a batch run side by side: chunks of CHUNK words
are first reduced to transfer matrices, these are chained per text, and then every chunk is filled in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.flat import LETTERS, flatten, mix, pieces, span_hash, word_bounds
from memloom.session import broadcast_if_small, cut_lineage

BITS = 17
AFFIXES = [1, 2, 3, 4]
GRAM = 3
CHUNK = 64
#: Bounds of the training sample: texts per language, training sequences, words in a sequence.
MOST_TEXTS, SEQUENCES, LENGTH = 800, 3000, 48
LEXICON_LEAST = 3
UNKNOWN = "und"


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


class Crf:
    """Feature weights (2^BITS by languages), transitions, and a lexicon from word hash to (language, strength)."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.emit = np.zeros((1 << BITS, n))
        self.move = np.zeros((n, n))
        self.words = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)

    def features(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, offsets per word) of the words at these spans."""
        n, hashed = len(starts), span_hash(data)
        parts = [hashes]
        for size in AFFIXES:
            for kind, lo, hi in ((1, starts, np.minimum(starts + size, ends)), (2, np.maximum(ends - size, starts), ends)):
                parts.append(mix(hashed(lo, hi) + np.uint64(16 * size + kind)))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            found = np.where(self.words[at] == hashes, self.entry[at] + 1, 0)
        else:
            found = np.zeros(n, np.int64)
        parts.append(mix(found.astype(np.uint64) + np.uint64(1 << 40)))
        fixed = np.stack(parts, axis=1)
        grams = np.maximum(ends - starts - GRAM + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(grams + fixed.shape[1])))
        out = np.empty(offsets[-1], np.uint64)
        heads = offsets[:-1, None] + np.arange(fixed.shape[1])
        out[heads] = fixed
        inner = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        lo = np.repeat(starts, grams) + inner
        out[np.repeat(offsets[:-1] + fixed.shape[1], grams) + inner] = mix(hashed(lo, lo + GRAM) + np.uint64(7))
        return (out >> np.uint64(64 - BITS)).astype(np.int64), offsets

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Emission scores per word; every word has features."""
        if len(offsets) < 2:
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.emit[ids], offsets[:-1], axis=0)


def chain_marginals(scores: np.ndarray, counts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of each word; counts: words per text, texts side by side.

    Exact whatever a text's length: chunks chain through their transfer matrices.
    """
    n, k = scores.shape
    if not n or not k:
        return scores
    step = np.exp(move - move.max())
    chunks = -(-counts // CHUNK)
    first_chunk = np.concatenate(([0], np.cumsum(chunks)))
    total = int(first_chunk[-1])
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), chunks)
    place = np.arange(total) - first_chunk[owner]
    begin = starts[owner] + place * CHUNK
    length = np.minimum(counts[owner] - place * CHUNK, CHUNK)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    width = int(length.max())
    live = np.arange(width)[:, None] < length[None, :]
    e = emit[np.minimum(begin[None, :] + np.arange(width)[:, None], n - 1)]  # (width, chunks, k)
    matrix = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(width):
        new = (matrix.reshape(-1, k) @ step).reshape(total, k, k) * e[t][:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        matrix = np.where(live[t][:, None, None], new, matrix)
    before, after = np.full((total, k), 1.0 / k), np.ones((total, k))
    for i in range(1, int(chunks.max()) if len(chunks) else 0):
        texts = np.flatnonzero(chunks > i)
        at = first_chunk[texts] + i
        v = np.einsum("cj,cjk->ck", before[at - 1], matrix[at - 1])
        before[at] = v / v.sum(1, keepdims=True)
        at = first_chunk[texts + 1] - 1 - i
        v = np.einsum("cjk,ck->cj", matrix[at + 1], after[at + 1])
        after[at] = v / v.sum(1, keepdims=True)
    forward = np.empty((width, total, k))
    state = before
    for t in range(width):
        new = (state @ step) * e[t]
        state = np.where(live[t][:, None], new / new.sum(1, keepdims=True), state)
        forward[t] = state
    out = np.empty((n, k))
    state = after
    for t in range(width - 1, -1, -1):
        both = forward[t] * state
        rows = live[t]
        out[begin[rows] + t] = both[rows] / both[rows].sum(1, keepdims=True)
        new = (e[t] * state) @ step.T
        state = np.where(rows[:, None], new / new.sum(1, keepdims=True), state)
    return out


def _pair_marginals(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (t, sequences, k) and expected transitions (k, k) of equally long sequences."""
    length, n, k = emit.shape
    step = np.exp(move - move.max())
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    forward = np.empty_like(e)
    state = np.full((n, k), 1.0 / k)
    for t in range(length):
        state = (state @ step) * e[t]
        state /= state.sum(1, keepdims=True)
        forward[t] = state
    back, expected, out = np.ones((n, k)), np.zeros((k, k)), np.empty_like(e)
    for t in range(length - 1, -1, -1):
        both = forward[t] * back
        out[t] = both / both.sum(1, keepdims=True)
        weighed = e[t] * back
        if t:
            joint = forward[t - 1][:, :, None] * step[None] * weighed[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
        back = weighed @ step.T
        back /= back.sum(1, keepdims=True)
    return out, expected


def fit(texts: list[str], labels: list[str], rounds: int = 30, rate: float = 0.1, seed: int = 7, sequences: int = SEQUENCES) -> Crf:
    """A model from whole texts with one language each; half of the training sequences switch between two languages or texts.

    A sequence draws its language first and then its text, each alike often, so every language with a word is
    taught; texts that are shorter than the sequence are chained until it is full.
    """
    model = Crf(sorted(set(labels)))
    k = len(model.languages)
    if not k:
        return model
    lang = np.array([model.languages.index(x) for x in labels])
    data, offsets = flatten(pa.array(texts, pa.large_string()))
    starts, ends, counts = word_bounds(data, offsets, LETTERS)
    hashes = span_hash(data)(starts, ends)
    word_lang = np.repeat(lang, counts)
    # The lexicon: words seen often enough, with their main language and how much they are its own.
    distinct, inverse = np.unique(hashes, return_inverse=True)
    table = np.stack([np.bincount(inverse[word_lang == i], minlength=len(distinct)) for i in range(k)], axis=1) if len(distinct) else np.zeros((0, k))
    often = table.sum(1) >= LEXICON_LEAST
    share = table[often].max(1) / table[often].sum(1)
    model.words = distinct[often]
    model.entry = table[often].argmax(1) * 3 + np.digitize(share, [0.7, 0.95])
    rng = np.random.default_rng(seed)
    worded = [np.flatnonzero((lang == i) & (counts > 0)) for i in range(k)]
    taught = [i for i in range(k) if len(worded[i])]
    if not taught:
        return model
    first = np.cumsum(counts) - counts
    rows, truth = [], []
    for i in range(sequences):
        cut = int(rng.integers(4, LENGTH - 4)) if i % 2 else LENGTH
        row, gold = [], []
        for n in (cut, LENGTH - cut):
            spoken = taught[rng.integers(len(taught))]
            gold.append(np.full(n, spoken))
            while n:
                t = worded[spoken][rng.integers(len(worded[spoken]))]
                size = min(n, int(counts[t]))
                row.append(first[t] + rng.integers(counts[t] - size + 1) + np.arange(size))
                n -= size
        rows.append(np.concatenate(row))
        truth.append(np.concatenate(gold))
    rows, truth = np.stack(rows, 1), np.stack(truth, 1)  # (LENGTH, sequences)
    used, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape)
    ids, bounds = model.features(data, starts[used], ends[used], hashes[used])
    known, dense = np.unique(ids, return_inverse=True)
    owner = np.repeat(np.arange(len(used)), np.diff(bounds))
    theta, move = np.zeros((len(known), k)), np.zeros((k, k))
    gold = np.eye(k)[truth]
    moved = np.zeros((k, k))
    np.add.at(moved, (truth[:-1].ravel(), truth[1:].ravel()), 1)
    squares = [np.full_like(theta, 1e-8), np.full_like(move, 1e-8)]
    for _ in range(rounds):
        scores = np.add.reduceat(theta[dense], bounds[:-1], axis=0)
        marginal, expected = _pair_marginals(scores[at], move)
        off = (gold - marginal).reshape(-1, k)
        flat = at.ravel()
        per_word = np.stack([np.bincount(flat, weights=off[:, i], minlength=len(used)) for i in range(k)], 1)
        grad = np.stack([np.bincount(dense, weights=per_word[owner, i], minlength=len(known)) for i in range(k)], 1) / sequences - 1e-4 * theta
        turn = (moved - expected) / sequences - 1e-4 * move
        for value, g, square in ((theta, grad, squares[0]), (move, turn, squares[1])):
            square += g * g
            value += rate * g / np.sqrt(square)
    model.emit[known] = theta
    model.move = move
    return model


def train(docs: DataFrame, learn: Column | None = None, seed: int = 0, most_texts: int = MOST_TEXTS, sequences: int = SEQUENCES) -> Crf:
    """A model from text and lang of the rows of `learn`; at most `most_texts` different texts per language reach the driver.

    They are those with the smallest hashes of their text, so reruns and repeated rows change nothing.
    """
    known = docs.where((learn if learn is not None else F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = known.select("lang", "text", F.xxhash64(F.lit(seed), "text").alias("_h"))
    # About twice as many as wanted pass a bar of the language's own, before anything is shuffled.
    bars = cut_lineage(hashed.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * most_texts) / F.count("*")).alias("_share")), "languages")
    bars = broadcast_if_small(bars, bars.count(), 256)
    place = F.pmod(F.col("_h"), F.lit(1 << 30))
    drawn = hashed.join(bars, "lang").where(place < F.col("_share") * (1 << 30))
    different = drawn.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(place, "_h")
    got = different.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most_texts).orderBy("lang", "_n").select("text", "lang").toArrow()
    return fit(got["text"].to_pylist(), got["lang"].to_pylist(), sequences=sequences)


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score (share of its words) and words of each whole text.

    Null texts and texts without a letter are UNKNOWN with score 0. Repeated rows are answered each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = flatten(piece.column(1))
                starts, ends, counts = word_bounds(data, offsets, LETTERS)
                hashes = span_hash(data)(starts, ends)
                _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                ids, bounds = model.features(data, starts[one], ends[one], hashes[one])
                marginal = chain_marginals(model.scores(ids, bounds)[inverse], counts, model.move)
                owner = np.repeat(np.arange(len(counts)), counts)
                sums = np.stack([np.bincount(owner, weights=marginal[:, i], minlength=len(counts)) for i in range(k)], 1) if k else np.zeros((len(counts), 1))
                best = sums.argmax(1)
                share = np.where(counts > 0, sums.max(1) / np.maximum(counts, 1), 0.0)
                ascii_letter = np.concatenate(([0], np.cumsum(LETTERS[data] & (data < 128))))
                plain = np.diff(ascii_letter[offsets]) > 0
                lettered = [k > 0 and (p or (c > 0 and any(x.isalpha() for x in t.as_py()))) for p, c, t in zip(plain, counts, piece.column(1))]
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], pa.string()),
                    pa.array(np.clip(np.where(lettered, share, 0.0), 0.0, 1.0)), pa.array(counts, pa.int64())], ["doc_id", "lang_pred", "score", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, words long")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (remainder 2; such rows teach nothing), lang_pred, score."""
    model = train(docs, F.coalesce(remainder() != 2, F.lit(False)))
    return predict(docs, model).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
