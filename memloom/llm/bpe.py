"""Byte-pair encoding with a public vocabulary, by batched merge rounds in numpy.

The words of a batch that were not met before lie in one flat array of symbols. Each round looks up all
adjacent pairs at once by binary search over the sorted pair keys, and every word merges its
lowest-ranked pair wherever it stands; words without a known pair are done. A word's encoding does not
depend on its neighbours, so a bounded cache per task keeps the rest cheap. A very long word has thousands of
different pairs, so its rounds touch only the places of their pair: links to the symbols before and after
and the places of every waiting rank are kept, and time grows with the word and not with its square.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.flat import pieces

WORDS_KEPT = 150_000
#: Words of so many bytes are merged each by itself.
LONG_WORD = 512


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary of the kind: NFC, white space folded, lower case, words split, byte letters, end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.splitter = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.width = max(self.names) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols and the (ascending) word of each, until no word has a known pair."""
        done_symbols, done_words, none = [], [], len(self.rank)
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = least == none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
                if not len(symbols):
                    break
            hit = rank == least
            # In a run of the same pair (aaaa) every second one merges, from the left.
            places = np.flatnonzero(hit)
            begins = np.concatenate(([True], np.diff(places) != 1))
            offset = np.arange(len(places)) - np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
            places = places[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of merges where there is none."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], len(self.rank))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rounds over one word, each over the places of its pair alone."""
        n, none = len(symbols), len(self.rank)
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            """Note the places (of left symbols) under the ranks of their pairs."""
            rank = self.ranks(symbols[places], symbols[after[places]])
            known = (rank < none) & (after[places] < n)
            places, rank = places[known], rank[known]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(places, cuts), rank[np.concatenate(([0], cuts))] if len(rank) else ()):
                if int(r) not in waiting:
                    heapq.heappush(queue, int(r))
                waiting.setdefault(int(r), []).append(part)

        wait(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places]]
            places = places[(after[places] < n) & (self.ranks(symbols[places], symbols[after[places]]) == r)]
            if not len(places):
                continue
            # In a run of the same pair (aaaa) every second one merges, from the left.
            begins = np.concatenate(([True], after[places[:-1]] != places[1:]))
            offset = np.arange(len(places)) - np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
            places = places[offset % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[r]
            alive[gone] = False
            after[places] = after[gone]
            before[after[places]] = places
            left = before[places]
            wait(np.unique(np.concatenate((places, left[left >= 0]))))
        return symbols[:n][alive[:n]]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word (non-empty, normalised, as the splitter leaves it)."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if long:
            out = dict(zip((i for i, w in enumerate(words) if len(w) <= LONG_WORD), self.encode_words([w for w in words if len(w) <= LONG_WORD])))
            for i in long:
                data = np.frombuffer(words[i].encode("utf-8"), np.uint8)
                out[i] = self.merge_long(np.append(self.inner[data[:-1]], self.last[data[-1]]))
            return [out[i] for i in range(len(words))]
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        symbols, word = self.merge(symbols, np.repeat(np.arange(len(words)), lengths))
        return np.split(symbols, np.searchsorted(word, np.arange(1, len(words))))

    def split(self, text: str) -> list[str]:
        """Words of a text in order; a special token's string is a word of its own kind, kept whole."""
        out: list[str] = []
        parts = self.specials.split(text) if "<|" in text else [text]
        for n, part in enumerate(parts):
            if n % 2:
                out.append(part)
            elif part:
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                # Lower case goes letter by letter: no final sigma.
                out += self.splitter.findall(part.replace("Σ", "σ").lower())
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks; when it is full it starts anew."""
        if len(self.known) + len(words) > WORDS_KEPT:
            self.known.clear()
        for text, i in self.special.items():
            self.known.setdefault(text, (1, str(i), text))
        missing = [w for w in words if w not in self.known]
        if missing:
            for w, ids in zip(missing, self.encode_words(missing)):
                ids = ids.tolist()
                self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text its words as (tokens, ids as text, tokens as text)."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        for words in split:
            yield [self.known[w] for w in words]


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _lists(rows: list[list[tuple[int, str, str]]]) -> tuple[np.ndarray, pa.ListArray]:
    """(tokens per text, ids as lists)."""
    counts = np.array([sum([w[0] for w in words]) for words in rows], dtype=np.int64)
    flat = np.fromstring(" ".join([w[1] for words in rows for w in words]), dtype=np.int32, sep=" ")
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return counts, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default doc_id) with n_tokens and tokens, an array of ids.

    A null or empty text has no tokens. Repeated rows are answered each.
    """
    keep = keep or ["doc_id"]
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", T.LongType()).add("tokens", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                counts, lists = _lists(list(bpe.encode(piece.column(len(keep)).to_pylist())))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(counts), lists], [*keep, "n_tokens", "tokens"])

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded: the names of the tokens joined by spaces, specials kept; no tokens (or null): the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = loaded(path).names
        for batch in batches:
            texts = [" ".join([names[i] for i in ids or []]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids (decimal, joined by one space) and of the decoded text."""
    sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for piece in pieces(batch):
                out = [(sum([w[0] for w in words]), sha(" ".join([w[1] for w in words])), sha(" ".join([w[2] for w in words])))
                       for words in bpe.encode(piece.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string())))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
