"""Texts of an Arrow batch as one byte array: word bounds and 64-bit word hashes without a Python loop per word.

Only ASCII bytes separate words, so UTF-8 needs no decoding. Batches are cut into pieces of about a
megabyte, which bounds the memory of a task whatever the batch holds; one longer text is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_table(ranges) -> np.ndarray:
    """A boolean table of bytes from pairs (first, last)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Bytes of words between white space, and of words of letters (all of UTF-8 above ASCII counts as letters).
NON_SPACE = ~byte_table([(9, 13), (32, 32)])
LETTERS = byte_table([(65, 90), (97, 122), (128, 255)])

_lower = np.arange(256)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: One fixed word per byte; upper and lower case of A to Z share theirs.
_BYTE_HASH = mix((_lower.astype(np.uint64) + np.uint64(1)) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES * 5 // 4)
        base = int(_ODD) if kind == "up" else pow(int(_ODD), -1, 1 << 64)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = have = np.cumprod(steps)
    return have


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about `most` bytes, one row at least."""
    index = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(starts, ends, words per text) of the maximal runs of the table's bytes inside each text."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = table[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    start = inside[:n] & ~(np.concatenate(([False], inside[:n - 1])) if n else inside[:n])
    start |= inside[:n] & border[:n]
    end = inside[:n] & (~inside[1:] | border[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hash(data: np.ndarray):
    """A function hashing byte spans [start, end), without regard to the case of A to Z."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_HASH[data] * _power("up", n)[:n], out=sums[1:])
    inverse = _power("down", n + 1)

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    return hashed


def words_of(texts: pa.Array, table: np.ndarray):
    """(word hashes, words per text)."""
    data, offsets = flatten(texts)
    starts, ends, counts = word_bounds(data, offsets, table)
    return span_hash(data)(starts, ends), counts
