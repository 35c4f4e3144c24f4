"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; everything else is an unlabelled mixture whose share of positives is
the class prior. A linear model over words and word beginnings minimises the corrected risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), where a negative correction is
stepped back from rather than fitted. Features carry the log ratio of their document frequencies, and
those that positives do not clearly prefer are left out, so the length of a text adds no noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.columns import set_aside
from memloom.llm.flat import LETTERS, flatten, pieces, span_hash, word_bounds
from memloom.session import cut_lineage

BITS = 18
PREFIXES = [4, 5]
#: Bounds of the training sample: positives and unlabelled texts, drawn by hash over the whole tables.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
#: What a feature must have: positives that show it (a number, and a share of all), and its ratio to unlabelled.
LEAST_SEEN, LEAST_SHARE, LEAST_RATIO = 4, 0.02, 3.0
THRESHOLD = 0.7


def remainder(of: str = "doc_id") -> Column:
    return F.crc32(F.col(of).cast("string").cast("binary")) % 3


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and every beginning of one, repeats included."""
    data, offsets = flatten(texts)
    starts, ends, counts = word_bounds(data, offsets, LETTERS)
    hashed, owner = span_hash(data), np.repeat(np.arange(len(counts)), counts)
    owners, ids = [owner], [hashed(starts, ends) >> np.uint64(64 - BITS)]
    for n in PREFIXES:
        longer = ends - starts > n
        owners.append(owner[longer])
        # Beginnings are told from words by another part of the hash.
        ids.append((hashed(starts[longer], starts[longer] + n) >> np.uint64(20)) & np.uint64((1 << BITS) - 1))
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def _distinct(owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((owner << BITS) | ids)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights of all features, bias) from the distinct features of each text, by full-batch Adam in numpy."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not positive or not unlabelled or not 0 < prior < 1:
        return weights, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    seen = [np.bincount(np.concatenate([*side, np.zeros(0, np.int64)]), minlength=1 << BITS) for side in (positive, unlabelled)]
    p, u = (seen[0] + 0.5) / (len(positive) + 1), (seen[1] + 0.5) / (len(unlabelled) + 1)
    ratio = np.where((seen[0] >= max(LEAST_SEEN, LEAST_SHARE * len(positive))) & (p > LEAST_RATIO * u), np.log(p / u), 0.0)
    chosen = np.flatnonzero(ratio)
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    flat = [column[np.concatenate([*side, np.zeros(0, np.int64)])] for side in (positive, unlabelled)]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (positive, unlabelled)]
    owner = [o[f >= 0] for o, f in zip(owner, flat)]
    flat = [f[f >= 0] for f in flat]
    scale = ratio[chosen]
    theta, bias = np.zeros(len(chosen) + 1), -1.0
    theta[:-1] = 0.5
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sides = [len(positive), len(unlabelled)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        logits = [np.bincount(o, weights=(theta[:-1] * scale)[f], minlength=n) + theta[-1] for o, f, n in zip(owner, flat, sides)]
        back = lambda side, g: np.append(np.bincount(flat[side], weights=g[owner[side]], minlength=len(chosen)) * scale, g.sum())
        # Logistic losses: of the label + it falls with the logit, of - it rises.
        plus = back(0, (sigmoid(logits[0]) - 1) / sides[0])
        minus_p = back(0, sigmoid(logits[0]) / sides[0])
        minus_u = back(1, sigmoid(logits[1]) / sides[1])
        rest = np.logaddexp(0, logits[1]).mean() - prior * np.logaddexp(0, logits[0]).mean()
        grad = prior * plus + (minus_u - prior * minus_p) if rest >= 0 else prior * minus_p - minus_u
        grad[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # what positives prefer never speaks against
    weights[chosen] = theta[:-1] * scale
    return weights, float(theta[-1])


def train(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, seed: int = 0, most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
) -> tuple[np.ndarray, float]:
    """A model from labels.toxic and unlabelled documents among the rows of `learn` (default: all).

    The prior is the share of toxic rows among all labelled ones. The driver gets the feature sets of at
    most `most_positive` confirmed and `most_unlabelled` other texts, whatever the tables hold: different texts with the
    smallest hashes, so reruns and repeated rows change nothing.
    """
    learn = learn if learn is not None else F.lit(True)
    marked = labels.where(learn).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    positives = [r[0] for r in marked.where("toxic = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_positive).select("doc_id").collect()]
    prior = (tally["t"] or 0) / tally["n"] if tally["n"] else 0.0
    rows = docs.where(learn).select("doc_id").count()
    # Half as many again as wanted, for rows may repeat.
    share = min(1.0, 1.5 * most_unlabelled / max(rows, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    confirmed = F.coalesce(F.col("doc_id").isin(positives), F.lit(False)) if positives else F.lit(False)
    sample = docs.where(learn & (confirmed | drawn)).select("text", confirmed.alias("confirmed"), drawn.alias("drawn"))
    different = cut_lineage(sample.groupBy(F.xxhash64(F.lit(seed), "text").alias("_h")).agg(
        F.first("text").alias("text"), F.max("confirmed").alias("confirmed"), F.max("drawn").alias("drawn")), "toxicity-sample")
    some = lambda side, most: different.where(side).orderBy("_h").limit(most).select(
        "text", F.lit(side == "confirmed").alias("confirmed"), F.lit(side == "drawn").alias("drawn"), "_h")
    sample = some("confirmed", most_positive).unionByName(some("drawn", most_unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                owner, ids = _distinct(*_features(piece.column(0)))
                split = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], lists], ["confirmed", "drawn", "_h", "features"])

    got = sample.mapInArrow(run, "confirmed boolean, drawn boolean, _h long, features array<int>").toArrow().sort_by([("_h", "ascending"), ("confirmed", "ascending")])
    sides: tuple[list, list] = ([], [])
    seen: tuple[set, set] = (set(), set())
    for is_positive, is_drawn, ids in zip(got["confirmed"].to_pylist(), got["drawn"].to_pylist(), got["features"]):
        ids = np.asarray(ids.values, dtype=np.int64)
        for side, member in ((0, is_positive), (1, is_drawn)):
            # Copies of one text teach once.
            if member and (key := hash(ids.tobytes())) not in seen[side]:
                seen[side].add(key)
                sides[side].append(ids)
    return fit(*sides, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default doc_id) with score: the model's probability for each whole text.

    Null and empty texts get the score of no features. Repeated rows are answered each.
    """
    weights, bias = model
    keep = keep or ["doc_id"]
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = rows.select(*keep).schema.add("score", "double")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                owner, ids = _features(piece.column(at))
                heavy = weights[ids] != 0
                owner, ids = _distinct(owner[heavy], ids[heavy])
                logits = np.bincount(owner, weights=weights[ids], minlength=piece.num_rows) + bias
                scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:len(keep)], pa.array(scores)], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (remainder 1; such rows teach no label), score, predicted at THRESHOLD."""
    learn = F.coalesce(remainder() != 1, F.lit(False))
    return score(docs, train(docs, labels, learn)).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` below THRESHOLD, all their columns kept."""
    learn = F.coalesce(remainder() != 1, F.lit(False))
    rows, names = set_aside(docs, ["doc_id", "text"])
    kept = score(rows, train(docs, labels, learn), rows.columns).where(F.col("score") < THRESHOLD)
    return kept.drop("score").toDF(*names)
