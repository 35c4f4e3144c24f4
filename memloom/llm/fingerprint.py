"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

A window's entropy falls into one of BINS bins; the fewer windows of the whole corpus share its bin, the
rarer it is. A window that is the rarest of its surroundings often enough is a feature. Features enter a
chain of Bloom filters in order, MOST per filter, and two chains are compared by their overlap beyond
chance, 0 to 1. All windows of a piece of the corpus are handled at once: how often a byte recurs within
a window comes from one comparison per distance, and entropies from running sums.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.flat import flatten, mix, pieces
from memloom.session import shared_dir

WINDOW = 64
BINS = 1000
#: Windows below this bin are all but constant and never features.
DULL = 100
#: A feature is the rarest of WINDOW successive windows at least so many times.
POPULAR = 16
BITS, HASHES, MOST = 2048, 5, 160

_SCALE = 1 << 10
_C = np.arange(WINDOW + 1)
_CLOG = np.round(_C * np.log2(np.maximum(_C, 1)) * _SCALE).astype(np.int32)
_GAIN = np.diff(_CLOG)  # from c to c + 1 equal bytes
_BLOCK = 1 << 18


def _recurrences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how often it occurs among the WINDOW - 1 bytes before it and after it."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for low in range(0, n, _BLOCK):  # blocks stay in the processor's cache
        part = data[max(0, low - WINDOW + 1):low + _BLOCK]
        skip = min(low, WINDOW - 1)
        own = np.zeros(len(part), np.uint8)
        later = np.zeros(len(part), np.uint8)
        for d in range(1, min(WINDOW, len(part))):
            same = (part[d:] == part[:-d]).view(np.uint8)
            own[d:] += same
            later[:-d] += same
        before[low:low + _BLOCK] = own[skip:]
        after[max(0, low - WINDOW + 1):low + _BLOCK] = np.where(
            np.arange(len(part)) < skip, after[max(0, low - WINDOW + 1):low + _BLOCK], later)
        if skip:  # the bytes just before the block see into it now
            tail = part[:skip]
            seen = np.zeros(skip, np.uint8)
            for d in range(1, WINDOW):
                stop = min(skip, len(part) - d)
                if stop > 0:
                    seen[:stop] += (tail[:stop] == part[d:d + stop]).view(np.uint8)
            after[low - skip:low] = seen
    return before, after


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The bin of the entropy of the window that starts at each byte; windows beyond the end have none (-1)."""
    n = len(data)
    bins = np.full(n, -1, dtype=np.int16)
    if n < WINDOW:
        return bins
    before, after = _recurrences(data)
    # The first window sums the gains of its bytes; each step drops a byte and adds one.
    first = int(sum(_GAIN[int((data[:i] == data[i]).sum())] for i in range(WINDOW)))
    steps = _GAIN[before[WINDOW:]] - _GAIN[after[:n - WINDOW]]
    total = np.concatenate(([0], np.cumsum(steps, dtype=np.int64))) + first
    bins[:n - WINDOW + 1] = np.round(BINS * (1 - total / (WINDOW * np.log2(WINDOW) * _SCALE))).astype(np.int16)
    return bins


def masked_bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """entropy_bins of texts that lie side by side; windows that leave their text have none."""
    bins = entropy_bins(data)
    ends = offsets[1:]
    for d in range(1, WINDOW):
        at = ends - d
        bins[at[at >= offsets[:-1]]] = -1
    return bins


def window_counts(docs: DataFrame) -> DataFrame:
    """(bin, n) over all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                bins = masked_bins(*flatten(piece.column(0)))
                counts += np.bincount(bins[bins >= 0], minlength=BINS + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bin", "n"])

    return docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def precedence(docs: DataFrame) -> list[int]:
    """For each bin its rank from the rarest; only BINS + 1 counts reach the driver."""
    counts = [0] * (BINS + 1)
    for row in window_counts(docs).collect():
        counts[row["bin"]] = row["n"]
    ranks = [0] * (BINS + 1)
    for rank, b in enumerate(sorted(range(BINS + 1), key=lambda b: (counts[b], b))):
        ranks[b] = rank
    return ranks


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each feature in order of place; the same window counts once in a text.

    A text with windows but no popular one offers its rarest; one shorter than a window is a feature
    itself, and an empty one has none.
    """
    n, lengths = len(data), np.diff(offsets)
    bins = masked_bins(data, offsets)
    none = np.int64(BINS + 2)
    rank = np.where(bins >= DULL, ranks[np.maximum(bins, 0)], np.where(bins >= 0, none - 1, none)).astype(np.int64)
    least = (rank << 40) | np.arange(n)
    for step in (1, 2, 4, 8, 16, 32):
        if n > step:
            least[:-step] = np.minimum(least[:-step], least[step:])
    chosen = least[bins >= 0] & ((1 << 40) - 1)
    change = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(chosen) else np.zeros(0, np.int64)
    popular = np.diff(np.append(change, len(chosen))) >= POPULAR
    places = chosen[change[popular]]
    places = places[rank[places] < none - 1]
    owner = np.searchsorted(offsets, places, "right") - 1
    lacking = np.setdiff1d(np.flatnonzero(lengths >= WINDOW), owner)
    if len(lacking):
        extra = np.array([offsets[t] + int(np.argmin(rank[offsets[t]:offsets[t + 1] - WINDOW + 1])) for t in lacking])
        places = np.sort(np.concatenate((places, extra)))
        owner = np.searchsorted(offsets, places, "right") - 1
    hashes = np.zeros(len(places), np.uint64)
    if len(places):
        windows = data[places[:, None] + np.arange(WINDOW)].view(np.uint64)
        for column in windows.T:
            hashes = mix(hashes ^ column)
    short = np.flatnonzero((lengths > 0) & (lengths < WINDOW))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.sha256(data[offsets[t]:offsets[t + 1]].tobytes()).digest()[:8], "little") for t in short], np.uint64)
        owner, hashes = np.concatenate((owner, short)), np.concatenate((hashes, whole))
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    if len(owner):
        order = np.lexsort((np.arange(len(owner)), hashes, owner))
        again = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        keep = np.sort(order[np.concatenate(([True], ~again))])
        owner, hashes = owner[keep], hashes[keep]
    return owner, hashes


def fingerprints(texts: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """For each text its chain as a boolean matrix of filters by bits; no rows for an empty text."""
    data, offsets = flatten(texts)
    owner, hashes = features(data, offsets, ranks)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    filters = -(-counts // MOST)
    first = np.concatenate(([0], np.cumsum(filters)))
    bits = np.zeros((int(first[-1]), BITS), dtype=bool)
    row = first[owner] + (np.arange(len(owner)) - starts[owner]) // MOST
    for i in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [bits[first[t]:first[t + 1]] for t in range(len(texts))]


def to_text(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode("ascii") if len(chain) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the shorter chain's filters of the best overlap beyond chance; two empty chains are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.sum() > b.sum()):
        a, b = b, a
    common = a.astype(np.float32) @ b.astype(np.float32).T
    na, nb = a.sum(1)[:, None].astype(float), b.sum(1)[None, :].astype(float)
    chance = na * nb / BITS
    score = (common - chance) / np.maximum(np.minimum(na, nb) - chance, 1e-9)
    return float(np.clip(score.max(1), 0.0, 1.0).mean())


def _bucketed(docs: DataFrame, rows_per_bucket: int = 500, most_buckets: int = 4096) -> DataFrame:
    """Rows dealt to ranges of doc_id; the first row of the range that follows is a guest (_guest 1).

    Ranges come from approximate quantiles of doc_id. Their heads, one number per range, are all that the
    driver sees; the number of ranges is bounded, and a range is streamed in order, never held.
    """
    ids = docs.select("doc_id")
    wanted = max(1, min(most_buckets, ids.count() // rows_per_bucket))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20000)).first()[0] if wanted > 1 else []
    cuts = sorted(set(cuts or []))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    coarse = longs(cuts[63::64])
    fine = F.array(*[longs(cuts[i:i + 63]) for i in range(0, len(cuts) + 1, 64)])
    below = lambda array, id_: F.size(F.filter(array, lambda c: c < id_))
    group = below(coarse, F.col("doc_id"))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(group * 64 + below(F.element_at(fine, group + 1), F.col("doc_id")))
    heads = {r["b"]: r["h"] for r in ids.select(bucket.alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("h")).collect()}
    filled = sorted(heads)
    # Bucket after which a bucket's head comes: the next one up; the highest head follows the lowest bucket.
    host = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    size = (filled[-1] if filled else 0) + 1
    head_of = F.element_at(longs([heads.get(b) for b in range(size)]), F.col("_b") + 1)
    host_of = F.element_at(F.array(*[F.lit(int(host.get(b, 0))) for b in range(size)]), F.col("_b") + 1)
    seat = lambda b, guest: F.struct(b.cast("int").alias("b"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("doc_id").eqNullSafe(head_of), F.array(seat(F.col("_b"), 0), seat(host_of, 1))).otherwise(F.array(seat(F.col("_b"), 0)))
    return docs.select("doc_id", "text", bucket.alias("_b")).select("doc_id", "text", F.explode(seats).alias("_seat")).select(
        "doc_id", "text", F.col("_seat.b").alias("_bucket"), F.col("_seat.guest").alias("_guest"))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def fingerprint_documents(docs: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and the likeness to both that and the next row's.

    Rows follow one another by descending doc_id (null last), then text; after the last comes the first.
    The edited text ends in the first half-length code points of the next text. Null texts are empty. A
    lone row is its own next. `ranks` fixes the rarity of bins; by default the corpus's own counts do.
    """
    order = np.array(ranks if ranks is not None else precedence(docs), dtype=np.int64)
    shared_dir(docs.sparkSession)

    def answer(rows: list[tuple], after: tuple | None, prints: list) -> pa.RecordBatch:
        """rows: (doc_id, text) each followed by the next one, the last by `after`; prints: of rows and after."""
        texts = [t for _, t in rows] + [after[1]]
        edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:])]
        theirs = fingerprints(pa.array(edited, pa.large_string()), order)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
            pa.array([to_text(p) for p in prints[:-1]], pa.string()), pa.array([to_text(p) for p in theirs], pa.string()),
            pa.array([likeness(p, q) for p, q in zip(prints, theirs)], pa.float64()),
            pa.array([likeness(p, q) for p, q in zip(prints, prints[1:])], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen, its print, its bucket
        for batch in batches:
            for piece in pieces(batch):
                ids, texts, buckets, guests = (piece.column(i).to_pylist() for i in range(4))
                texts = [t or "" for t in texts]
                prints = fingerprints(pa.array(texts, pa.large_string()), order)
                rows = [*([held] if held else []), *zip(ids, texts, prints, buckets, guests)]
                ready, i = [], 0
                for a, b in zip(rows, rows[1:]):
                    if not a[4] and a[3] == b[3]:
                        ready.append((a, b))
                # Runs of rows in which each one's next follows are answered together.
                while i < len(ready):
                    j = i
                    while j + 1 < len(ready) and ready[j][1] is ready[j + 1][0]:
                        j += 1
                    chain = [p[0] for p in ready[i:j + 1]]
                    last = ready[j][1]
                    yield answer([(c[0], c[1]) for c in chain], (last[0], last[1]), [*(c[2] for c in chain), last[2]])
                    i = j + 1
                held = rows[-1]

    dealt = _bucketed(docs).repartition("_bucket").sortWithinPartitions(
        "_bucket", "_guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.mapInArrow(run, OUT)
