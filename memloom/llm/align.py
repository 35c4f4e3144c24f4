"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text into groups.

Labelling is by pointer jumping. Every token of one tokenizer points to its farthest-right overlapping token of
the other, or to itself where nothing reaches farther; successors are doubled for all tokens of a batch at once
until nothing changes, and each token then knows its group's terminal token. Links are the stretches between
neighbouring ends of either side: each lies in just one token of A and one of B.

Corpus-wide counts travel as blocks of documents: a block sends each distinct id pair once, with its number,
and gets the pair's total back; the links of its documents are places in the block's list of pairs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.counts import encode_long
from memloom.llm.flat import pieces
from memloom.llm.vocab import Memory, load
from memloom.session import cut_lineage

#: Bytes of text in a block, and code points from which on a text is encoded chunk by chunk.
BLOCK_BYTES = 2 << 20
LONG = 1 << 18


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token, a place in B, of every token of A and of B, from ascending ends over the same bytes."""
    n = len(ends_a)
    # The first token of the other side that ends at or behind this token's end overlaps it farthest to the right.
    from_a = n + np.searchsorted(ends_b, ends_a, "left")
    from_b = np.searchsorted(ends_a, ends_b, "left")
    own = np.arange(n, n + len(ends_b))
    after = np.concatenate((from_a, np.where(ends_a[from_b] > ends_b, from_b, own))) if n else own
    while True:
        jumped = after[after]
        if np.array_equal(jumped, after):
            return after[:n] - n, after[n:] - n
        after = jumped


class Aligner:
    """Both vocabularies with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.models = load(path_a, plain=True), load(path_b)
        # A reads a space before each stretch, B adds it by itself.
        self.memory = Memory(self._pairs, self.models[1].gap if self.models[0].gap else None)
        self.bytes = [m.token_bytes() for m in self.models]
        self.lengths = [np.array([len(b) for b in table]) for table in self.bytes]
        self.width = self.models[1].size
        # Decimal ids, padded with NUL, each followed by the mark that may come after it.
        names = max(m.size for m in self.models)
        self.names = np.array([[f"{i}{mark}".encode() for i in range(names)] for mark in ",|;"])

    def _spelled(self, text: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Ids of A and B as 32-bit words, or None where either does not spell out space+text."""
        want = b" " + text.encode()
        if any(b"".join([table[i] for i in ids]) != want for table, ids in zip(self.bytes, (a, b))):
            return None
        return array("i", a).tobytes(), array("i", b).tobytes()

    def _pairs(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        return list(map(self._spelled, texts, self.models[0].ids([" " + t for t in texts]), self.models[1].ids(texts)))

    def _long(self, text: str) -> list[tuple[bytes, bytes] | None]:
        return [self._spelled(text, encode_long(self.models[0], " " + text).tolist(), encode_long(self.models[1], text).tolist())]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """Ids of A and B and the bytes of each text; none where text is empty or the tokens do not spell space+text."""
        short = iter(self.memory.of([t for t in texts if len(t) <= LONG]))
        a, b, sizes = [], [], []
        for text in texts:
            told = next(short) if len(text) <= LONG else self._long(text)
            good = bool(text) and None not in told
            a.append(np.frombuffer(b"".join([x for x, _ in told]) if good else b"", np.int32))
            b.append(np.frombuffer(b"".join([y for _, y in told]) if good else b"", np.int32))
            sizes.append(len(text.encode()) + 1 if good else 0)
        return a, b, sizes

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, groups as bytes) of each text, pair of each link, links per text)."""
        a, b, sizes = self.tokens(texts)
        counts = [np.array([len(x) for x in side]) for side in (a, b)]
        a, b = (np.concatenate(side).astype(np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        label_a, label_b = terminals(ends_a, ends_b)
        # Every group has one terminal; they stand in the order of the text.
        last = np.unique(label_b)
        group = np.concatenate((np.searchsorted(last, label_a) * 2, np.searchsorted(last, label_b) * 2 + 1))
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate((a, b))[order]
        step = np.diff(group, append=group[-1:] + 1)
        names = self.names[np.where(step == 0, 0, np.where((group & 1) == 0, 1, 2)), ids]
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        pairs = a[np.searchsorted(ends_a, ends)] * self.width + b[np.searchsorted(ends_b, ends)] if len(ends) else ends
        stops = np.cumsum(sizes)
        links = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
        groups = np.diff(np.searchsorted(ends_b[last], stops, "right"), prepend=0)
        upto = np.concatenate(([0], np.cumsum(counts[0] + counts[1])))
        spelled = [names[i:j].tobytes().replace(b"\0", b"")[:-1] for i, j in zip(upto[:-1], upto[1:])]
        return list(zip(counts[0].tolist(), counts[1].tolist(), groups.tolist(), links.tolist(), spelled)), pairs, links


_aligners: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("block", T.LongType()), ("doc_id", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()),
    ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("gaps", T.ArrayType(T.IntegerType())),
    ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())))])
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
                    ("groups_sha256", pa.string()), ("gaps", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """A row per document, its links as the gaps between the sorted places of their pairs, and one row per block with its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", block_bytes):
                number += 1
                rows, links, counts = [], [], []
                for part in pieces(piece, "text", block_bytes // 4):
                    more = both.align([t or "" for t in part.column(1).to_pylist()])
                    rows += more[0]
                    links.append(more[1])
                    counts.append(more[2])
                counts = np.concatenate(counts)
                pairs, place = np.unique(np.concatenate(links), return_inverse=True)
                # Sorted inside each document; the first gap of a document counts from 0.
                owner = np.repeat(np.arange(len(counts)), counts)
                place = np.sort(owner * max(1, len(pairs)) + place) - owner * max(1, len(pairs))
                gaps = np.diff(place, prepend=0)
                begins = (np.cumsum(counts) - counts)[counts > 0]
                gaps[begins] = place[begins]
                n = len(rows)
                sha = ["" if not r[0] else hashlib.sha256(r[4]).hexdigest() for r in rows]
                columns = [piece.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array(sha, pa.string()),
                           _lists(gaps, counts, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *columns], schema=_ARROW)
                times = np.bincount(place, minlength=len(pairs))
                yield pa.RecordBatch.from_pylist([{"block": number, "pairs": pairs, "times": times}], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _scored(table: pa.Table, told: pa.Table) -> pa.Table:
    """The documents of one block with n_best and count_sum, from the totals of the block's pairs."""
    at = told["at"].to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = told["total"].to_numpy(), told["best"].to_numpy()
    gaps = table["gaps"].combine_chunks()
    gaps, counts = gaps.flatten().to_numpy(), pc.list_value_length(gaps).to_numpy()
    stops = np.cumsum(counts)
    place = np.cumsum(gaps, dtype=np.int64)
    # The running sum starts anew with every document.
    place -= np.repeat(np.concatenate(([0], place))[stops - counts], counts)
    sums = [np.concatenate(([0], np.cumsum(x[place]))) for x in (best, total)]
    n_best, count_sum = (pa.array(s[stops] - s[stops - counts], pa.int64()) for s in sums)
    return table.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column(
        "n_best", n_best).append_column("count_sum", count_sum)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): the links of each id pair, and 1 where no other pair of its B id has more."""
    totals = blocks.where("pairs is not null").select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    totals = totals.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % width)
    totals = cut_lineage(totals, "pair-counts")
    # At most one row for each id of the vocabulary: a proven bound.
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Null and empty texts, and texts that either tokenizer does not spell out byte by byte, have no tokens:
    zeros and an empty string. Repeated rows count each; a null doc_id is kept; other columns are ignored. A
    text of more than 2^18 code points is encoded chunk by chunk. A task holds one block: two megabytes of
    text, or one longer text, whose arrays take about 100 bytes for each of its bytes.
    """
    blocks = cut_lineage(_blocks(docs, path_a, path_b, block_bytes), "aligned")
    width = load(path_b).size
    told = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair")).join(
        pair_counts(blocks, width), "pair").select(F.col("block").alias("of_block"), "at", "total", "best")
    rows = blocks.where("pairs is null").drop("pairs", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(_scored, schema).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
