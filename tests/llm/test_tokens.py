"""Alignment and token counts: against the libraries and a plain alignment."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from memloom.llm import align, counts, vocab
from memloom.llm.queries import QUERIES, tokenizer_path

ALPHABET = ["a", "ab", "'s", "'ll", " ", "  ", "\n", "é", "é", "́" * 3, "日本語", "🎉", "<|endoftext|>", "<|start", "oftext|>", "12", "!?",
            "Hello", "ing", "ΑΣ", "ſ", "하", "\x00", "\x85", "　", " x ", " ́"]
HARD = ["a" * 5000, "abc" * 2000, "日本語の文章" * 600, "." * 4000, " " * 4000, "́" * 3000 + "x" * 3000, "x" + "́" * 2000 + "abc" * 900,
        " !'s" * 1500, "ab" * 3000 + " <|endoftext|>" * 200, "the quick brown fox " * 400]


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


KINDS = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True), ("piece_bpe_32k.model", False)]


def noise(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("name, plain", KINDS)
def test_spliced_chunks_equal_the_whole_encoding(name, plain):
    model = vocab.load(path(name), plain)
    for text in [*HARD, *noise(8, 1500, 1)]:
        for chunk, overlap in ((400, 200), (777, 300)):
            assert counts.encode_long(model, text, chunk, overlap).tolist() == model.ids([text])[0]


@pytest.mark.parametrize("name, plain", KINDS)
def test_stretches_equal_the_whole_encoding(name, plain, monkeypatch):
    model = vocab.load(path(name), plain)
    monkeypatch.setattr(vocab, "STRETCHES_KEPT", 500)
    memory, texts = vocab.Memory(model.ids, model.gap), noise(300, 60, 2)
    assert model.gap
    for part in (texts[:150], texts[150:], texts[:20], texts[100:220]):
        assert [sum(told, []) for told in memory.of(part)] == model.ids(part)
    assert vocab.Memory(model.ids, None).of(texts[:3]) == [[x] for x in model.ids(texts[:3])]


def test_ranks_equal_the_json_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(path("byte_bpe_50k.json")), vocab.load(path("byte_bpe_50k.json"), True)
    library.encode_special_tokens = True
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xd7ff), rng.randrange(0x10000, 0x20000), 10, 32, 32])) for _ in range(40)) for _ in range(4000)]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()] + odd + HARD + noise(50, 300, 6)
    assert model.ranked and vocab.load(path("word_bpe_49k.json"), True).ranked is None
    assert model.ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_overlap_their_successor_only():
    for text in [*HARD, *noise(5, 2000, 3)]:
        spans = counts.cut_text(text, 300, 150)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] < a[1] < b[1] for a, b in zip(spans, spans[1:])) and all(c[0] >= a[1] for a, c in zip(spans, spans[2:]))
        assert all(counts.stable(text[a]) for a, _ in spans[1:])


def test_an_unproven_boundary_is_refused():
    # Both chunks of a run of one letter see tokens of 32 letters, at places that never meet.
    model, text = vocab.load(path("word_bpe_49k.json")), "a" * 1000
    whole = [model.tokens(text[a:b]) for a, b in ((0, 500), (301, 1000))]
    assert counts.splice(whole[0], counts._moved(whole[1], 301), 301, 500) is None
    assert counts.widened(model, text[:500], text[301:], 301, 0, 699) is None
    # A longer overlap reaches the next word.
    text = "a" * 700 + " and so on with other words that stand behind it in peace and quiet and then some" * 3
    found = counts.widened(model, text[:500], text[301:], 301, 0, len(text) - 301)
    assert len(model.tokens(text[:500 + 399]).ids) >= found[0] > found[1] > 0
    assert found[0] - found[1] + len(model.tokens(text[301:]).ids) == len(model.ids([text])[0])


def test_counts_equal_the_library(spark, odd, odd_rows, none, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == (len((rows[r["doc_id"]] or "").encode()), size(rows[r["doc_id"]]))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    want = sorted((str(i), len((t or "").encode()), size(t)) for i, t, *_ in odd_rows)
    for chunk, overlap in ((counts.CHUNK, counts.OVERLAP), (300, 150)):
        got = counts.count_tokens(odd, tokenizer_path(), chunk=chunk, overlap=overlap).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert counts.count_tokens(none, tokenizer_path()).collect() == []


def test_huge_texts_are_widened_or_put_together(spark):
    rows = [(i, t) for i, t in enumerate([*HARD, *noise(6, 3000, 4)])]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        model = vocab.load(path(name))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(df, path(name), chunk=400, overlap=160).collect()}
        assert got == {i: len(model.ids([t])[0]) for i, t in rows}


def plain_alignment(text, both):
    """(a ids, b ids, groups, links) with the bounds of every token written out."""
    a, b = both.models[0].ids([" " + text])[0], both.models[1].ids([text])[0]
    spans = []
    for ids, table in ((a, both.bytes[0]), (b, both.bytes[1])):
        at, mine = 0, []
        for i in ids:
            mine.append((i, at, at + len(table[i])))
            at += len(table[i])
        spans.append(mine)
        if not text or b"".join(table[i] for i in ids) != b" " + text.encode():
            return [], [], [], []
    cuts, low, groups = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]}), 0, []
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
        low = cut
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
    return a, b, groups, links


def check_alignment(got, rows, both):
    told = [(i, *plain_alignment(t or "", both)) for i, t in rows]
    total = Counter(link for *_, links in told for link in links)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    want = [(str(i), len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, groups, links in told]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_alignment_equals_a_plain_one(spark, odd, odd_rows, none, sf_dir, monkeypatch):
    paths = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    both = align.aligner(*paths)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000 or text is null").select("doc_id", "text")
    got = align.align_documents(docs, *paths, block_bytes=20_000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check_alignment(got.collect(), docs.collect(), both)
    small = odd.where("text is null or length(text) < 5000")
    check_alignment(align.align_documents(small, *paths).collect(), [(r["doc_id"], r["text"]) for r in small.collect()], both)
    assert align.align_documents(odd, *paths).count() == len(odd_rows)
    assert align.align_documents(none, *paths).collect() == []
    texts = ["a ▁ b", "x", "", "<|endoftext|>", "🎉" * 50, "日本語" * 40, *noise(4, 80, 5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check_alignment(align.align_documents(df, *paths).collect(), rows, both)
    # Texts beyond LONG go chunk by chunk.
    long = [*HARD[:4], "the quick brown fox " * 2000]
    want = both.tokens(long)
    monkeypatch.setattr(align, "LONG", 100)
    assert all((x == y).all() for mine, theirs in zip(want[:2], both.tokens(long)[:2]) for x, y in zip(mine, theirs))


def test_pointer_jumping_finds_the_shared_ends():
    import numpy as np

    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n})) for _ in range(2))
        label_a, label_b = align.terminals(a, b)
        shared = np.intersect1d(a, b)
        for ends, label in ((a, label_a), (b, label_b)):
            assert (b[label] == shared[np.searchsorted(shared, ends)]).all()
