"""The public tokenizer libraries behind one small face: ids and token spans of texts, counts of many texts.

`.json` files are read by the tokenizers library, `.model` files by sentencepiece. Spans are code points
of the text. A token's `word` is the number of the pre-token (the unit inside which merges run) it lies in.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np

from memloom.llm.bpe import byte_letters


# Fixed value: the pre-tokens that a vocabulary file means by `ByteLevel` with `use_regex`.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Tokens:
    """Tokens of one text: ids, first and end code point, pre-token; `whole` is false where a character is split."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    whole: np.ndarray

    def cut(self, first: int, end: int) -> Tokens:
        return Tokens(*(getattr(self, n)[first:end] for n in ("ids", "starts", "ends", "words", "whole")))


class JsonVocabulary:
    """A vocabulary of the tokenizers library; `plain` reads the strings of special tokens as ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        # One task is one core: the library's own threads would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        # Pre-tokens that leave white space out, or that take a space only as the start of what follows it.
        spaced = (first.get("behavior") == "Removed" and first.get("invert") and "[^\\s" in pattern and " " not in pattern) or (
            first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not spec["normalizer"])
        self.gap = re.compile(r"(?<=\S)(?= \S)") if spaced else None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.ranked = self._ranked(spec) if plain else None

    def _ranked(self, spec: dict):
        """The same encoding by ranks, several times as fast, where the file is no more than merges of bytes in order of their ids."""
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        names, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
            and all(names.get(c, 256) < 256 for c in letters) and all(names.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)))
        if not plain:
            return None
        import tiktoken

        added = set(self.library.get_added_tokens_decoder())
        ranks = {b: i for i, b in enumerate(self.token_bytes()) if i not in added}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> Tokens:
        told = self.library.encode(text, add_special_tokens=False)
        spans = np.array(told.offsets, dtype=np.int64).reshape(-1, 2)
        starts, ends = spans[:, 0], spans[:, 1]
        whole = np.ones(len(starts), dtype=bool)
        # The byte tokens of one character all carry its span.
        whole[1:] &= starts[1:] >= ends[:-1]
        whole[:-1] &= ends[:-1] <= starts[1:]
        words = np.array([-1 if w is None else w for w in told.word_ids], dtype=np.int64)
        return Tokens(np.array(told.ids, dtype=np.int64), starts, ends, words, whole)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        names = [added.get(i, self.library.id_to_token(i)) for i in range(self.size)]
        return [names[i].encode() if i in added else bytes(byte_of[c] for c in names[i]) for i in range(self.size)]


class PieceVocabulary:
    """A vocabulary of sentencepiece; the whole text is one pre-token."""

    special: list[str] = []

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self._lengths = np.array([len(b) for b in self.token_bytes()])
        # No piece has a space behind another character, so no merge crosses a single space; the library adds it anew.
        spaced = not any("▁" in self.library.id_to_piece(i).lstrip("▁") for i in range(self.size))
        self.gap = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])") if spaced else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def tokens(self, text: str) -> Tokens:
        ids = np.array(self.library.encode(text), dtype=np.int64)
        # The library writes a space before the text, whose place is -1, and reads U+2581 as one.
        data = np.frombuffer((" " + text.replace("▁", " ")).encode(), np.uint8)
        ends = np.cumsum(self._lengths[ids])
        if not len(ids) or ends[-1] != len(data):
            none = np.full(len(ids), -1)
            return Tokens(ids, none, none, np.zeros(len(ids), np.int64), np.zeros(len(ids), bool))
        lead = np.append((data & 0xC0) != 0x80, True)
        place = np.cumsum(lead) - 2
        starts = ends - self._lengths[ids]
        return Tokens(ids, place[starts], place[ends], np.zeros(len(ids), np.int64), lead[starts] & lead[ends])

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: a byte piece is its byte, U+2581 a space."""
        piece = self.library.id_to_piece
        return [bytes([int(piece(i)[3:5], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode()
                for i in range(self.size)]


STRETCHES_KEPT, STRETCH_CHARS_KEPT = 100_000, 16 << 20


class Memory:
    """What an encoder says of the stretches between single spaces, remembered in two bounded generations.

    A single space between two characters that are not white space bounds a stretch where the vocabulary proves
    it (`gap`): no pre-token or merge crosses it, no normalisation joins over it and no special token holds it.
    Without a gap whole texts are encoded. A full generation becomes the old one; what is met again moves
    to the new one, so frequent stretches stay.
    """

    def __init__(self, encode: Callable[[list[str]], list], gap: re.Pattern | None) -> None:
        self.encode, self.gap = encode, gap
        self.new: dict = {}
        self.old: dict = {}
        self.room = STRETCH_CHARS_KEPT

    def of(self, texts: list[str]) -> list[list]:
        """For each text what the encoder says of its stretches."""
        if self.gap is None:
            return [[told] for told in self.encode(texts)]
        parts = [self.gap.split(t) for t in texts]
        if len(self.new) > STRETCHES_KEPT or self.room < 0:
            self.old, self.new, self.room = self.new, {}, STRETCH_CHARS_KEPT
        new, old = self.new, self.old
        unseen = [p for p in set(chain.from_iterable(parts)) if p not in new]
        self.room -= sum(map(len, unseen))
        new.update([(p, old[p]) for p in unseen if p in old])
        missing = [p for p in unseen if p not in old]
        if missing:
            new.update(zip(missing, self.encode(missing)))
        return [[new[p] for p in some] for some in parts]


_loaded: dict = {}


def load(path: str, plain: bool = False):
    """The vocabulary of a file, read once in a process."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = JsonVocabulary(path, plain) if path.endswith(".json") else PieceVocabulary(path)
    return _loaded[path, plain]


def count_memory(path: str) -> Memory:
    """Token counts of stretches, one memory in a process."""
    if (path, "counts") not in _loaded:
        model = load(path)
        _loaded[path, "counts"] = Memory(lambda parts: [len(ids) for ids in model.ids(parts)], model.gap)
    return _loaded[path, "counts"]
