"""Secrets: fixed shapes, and strings whose windows are more random than their alphabet usually is.

Candidates are long runs of key characters. A window slides over each; its counts change by one
character in and one out, and with them the sum of c * log2(c), hence the entropy, for all candidates of
a batch at once. A candidate whose best window exceeds the bound of its character class is a secret,
unless the allow-list knows its shape. The allow-list concerns these added spans only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memloom.llm.flat import pieces

#: Kinds in the order of every listing; the last is the method's own.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "entropy"]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Matches of these two are whole runs, so the shorter ones need not be matched to be dropped.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST = 6

WINDOW = 20
#: Longer candidates are slid over in stretches of so many characters, side by side; neighbours share all but one of a window's.
STRETCH = 4096
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: (class, whole-string pattern, least bits per character in a window of WINDOW); the first that fits counts.
CLASSES = [
    ("hex", re.compile(r"(?=.*[0-9])[0-9a-fA-F]+"), 3.0),
    ("alnum", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+"), 3.6),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+"), 3.7),
]
#: Shapes that are no secrets however random: identifiers of rows, words joined by marks, placeholders, paths.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z]+([-_/][A-Za-z]+)*|[0-9]+([-_/][0-9]+)*"
    r"|(?i:.*(example|sample|dummy|placeholder|xxxx).*)|/?([A-Za-z0-9_-]{1,15}/){2,}[A-Za-z0-9_-]{0,15}")

_C = np.arange(WINDOW + 1, dtype=float)
_CLOG = np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0.0)


def window_entropy(candidates: list[str]) -> np.ndarray:
    """The greatest Shannon entropy (bits per character) of any window of each ASCII candidate, all at once."""
    if not candidates:
        return np.zeros(0)
    if max(map(len, candidates)) > STRETCH:
        step = STRETCH - WINDOW + 1
        parts = [(n, c[at:at + STRETCH]) for n, c in enumerate(candidates) for at in range(0, max(1, len(c) - WINDOW + 1), step)]
        best = np.full(len(candidates), -np.inf)
        np.maximum.at(best, [n for n, _ in parts], window_entropy([part for _, part in parts]))
        return best
    lengths = np.array([len(c) for c in candidates])
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer("".join(candidates[i] for i in order).encode("ascii"), np.uint8)
    lengths = lengths[order]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = np.zeros((len(order), 128), dtype=np.int16)
    total = np.zeros(len(order))  # sum of c * log2(c)
    best = np.full(len(order), np.inf)  # the least sum is the greatest entropy
    rows = np.arange(len(order))
    for i in range(int(lengths[0])):
        live = rows[:int(np.searchsorted(-lengths, -i, "left"))]
        if i >= WINDOW:
            out = flat[starts[live] + i - WINDOW]
            c = counts[live, out]
            total[live] += _CLOG[c - 1] - _CLOG[c]
            counts[live, out] = c - 1
        new = flat[starts[live] + i]
        c = counts[live, new]
        total[live] += _CLOG[c + 1] - _CLOG[c]
        counts[live, new] = c + 1
        if i >= WINDOW - 1:
            best[live] = np.minimum(best[live], total[live])
    entropy = np.empty(len(order))
    entropy[order] = np.log2(WINDOW) - best / WINDOW
    return entropy


def _bound(text: str) -> float | None:
    """The entropy that makes this string a secret; None where nothing does."""
    if ALLOW.fullmatch(text):
        return None
    return next((bound for _, shape, bound in CLASSES if shape.fullmatch(text)), None)


def find_spans(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text by start, then kind as listed; code points, ends exclusive."""
    found: list[list[tuple[int, int, int]]] = []
    asked, places = [], []
    for n, text in enumerate(texts):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LEAST]
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        for m in _CANDIDATE.finditer(text):
            bound = _bound(m[0])
            if bound is not None:
                asked.append(m[0])
                places.append((n, m.start(), m.end(), bound))
        found.append(spans)
    for (n, start, end, bound), bits in zip(places, window_entropy(asked)):
        if bits >= bound:
            found[n].append((start, 3, end))
    return [[(KINDS[k], start, end) for start, k, end in sorted(spans)] for spans in found]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `secrets`, an array of (kind, start, end) by start, then kind as listed.

    A null or empty text has an empty array. Spans of different kinds may overlap. Repeated rows are
    answered each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for piece in pieces(batch):
                spans = find_spans(piece.column(1).to_pylist())
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in one] for one in spans]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, kind)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:int,end:int>>")


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by [secret]."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "[secret]"]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` with the secrets masked and n_chars, where there is one, counted anew.

    Null texts stay null with the n_chars that they came with.
    """
    columns = docs.columns
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                arrays, texts = list(piece.columns), piece.column(at).to_pylist()
                masked = [mask(t, s) for t, s in zip(texts, find_spans(texts))]
                arrays[at] = pa.array(masked, piece.column(at).type)
                if chars >= 0:
                    old = piece.column(chars)
                    arrays[chars] = pa.array([o if m is None or m == t else len(m) for o, m, t in zip(old.to_pylist(), masked, texts)], old.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=piece.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in one] for one in batch.column(1).to_pylist()]
            base = [",".join(x for k, x in one if k in BASE_KINDS) for one in rows]
            counts = [pa.array([sum(k == kind for k, _ in one) for one in rows], pa.int64()) for kind in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                 pa.array([",".join(x for _, x in one) for one in rows], pa.string())],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
