"""Secrets, tokens, mixing and fingerprints: against brute force and on odd tables."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from memloom.llm import bpe, fingerprint, mixing, secrets
from memloom.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute


def test_secrets_equal_brute_force(spark, odd, odd_rows, none, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op7_secrets"](spark, sf_dir).collect():
        assert (list(r[1:4]), r["base_sha256"]) == brute.secrets(rows[r["doc_id"]])
    got = sorted((str(r["doc_id"]), *r[1:5]) for r in secrets.digest(secrets.scan_secrets(odd)).collect())
    assert got == sorted((str(i), *brute.secrets(t)[0], brute.secrets(t)[1]) for i, t, *_ in odd_rows)
    assert secrets.digest(secrets.scan_secrets(none)).collect() == []


def test_window_entropy_is_that_of_the_best_window():
    for text in ("a" * 30, "abcdefghijklmnopqrstuvwxyz0123", "aaaaaaaaaaaaaaaaaaaabcdefghijklmnopqrst", "ab" * 10):
        w = secrets.WINDOW
        want = max(-sum(c / w * math.log2(c / w) for c in Counter(text[i:i + w]).values()) for i in range(len(text) - w + 1))
        assert secrets.window_entropy([text, "zz" * 15])[0] == pytest.approx(want)


def test_stretches_do_not_show():
    rng = np.random.default_rng(8)
    text = "".join(map(chr, rng.integers(97, 100, 9000))) + "abcdefghijklmnopqrst" + "".join(map(chr, rng.integers(97, 100, 3000)))
    w = secrets.WINDOW
    want = max(-sum(c / w * math.log2(c / w) for c in Counter(text[i:i + w]).values()) for i in range(len(text) - w + 1))
    for t in (text, text[:secrets.STRETCH], text[:secrets.STRETCH + 1], text[9000 - secrets.STRETCH + 10:]):
        told = secrets.window_entropy([t, "zz" * 15])
        assert told[0] == pytest.approx(want if "abcdefghijklmnopqrst" in t else max(
            -sum(c / w * math.log2(c / w) for c in Counter(t[i:i + w]).values()) for i in range(len(t) - w + 1)))


def test_a_very_long_key_takes_seconds():
    import time

    key = hashlib.sha256(b"1").hexdigest() * 50_000
    start = time.process_time()
    assert secrets.find_spans(["token " + key.upper()[:2_000_000] + "Aa1"])[0][-1][0] == "entropy"
    assert time.process_time() - start < 30


def test_added_spans_and_allow_list():
    kinds = lambda t: [k for k, _, _ in secrets.find_spans([t])[0]]
    assert kinds("x dGhpc0lzQVNlY3JldEtleTk4NzY1NDMyMQ y") == ["entropy"]
    assert kinds("123e4567-e89b-12d3-a456-426614174000") == [] and kinds("averyveryverylongwordindeedyes") == []
    assert kinds("exampleA1b2C3d4E5f6G7h8I9j0K1") == []
    assert secrets.mask("a token=abcdef b", [("assign", 2, 14), ("entropy", 8, 14)]) == "a [secret] b"


def test_masking_keeps_rows_and_columns(spark, odd, odd_rows):
    got = secrets.mask_secrets(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    row = got.where("doc_id = 11").first()
    assert "24be64" not in row["text"] and row["n_chars"] == len(row["text"])
    assert got.where("doc_id = 4").first()["text"] is None


def test_tokens_equal_the_library(spark, odd, odd_rows, none, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op8_bpe"](spark, sf_dir).collect():
        assert tuple(r[1:]) == want(rows[r["doc_id"]])
    got = sorted((str(r[0]), *r[1:]) for r in bpe.digest_documents(odd, tokenizer_path()).collect())
    assert got == sorted((str(i), *want(t)) for i, t, *_ in odd_rows)
    assert bpe.digest_documents(none, tokenizer_path()).collect() == []
    hard = ["aaaa aaaaaaa", "it's we'LL İıI ǅ", "<|endoftext|>A<|startoftext|>", "a\x00b\x85c\x1cd", "ΣΑΣ", "½²٣４", "퟿🎉🎉", "éÅ"]
    model = bpe.loaded(tokenizer_path())
    for text, words in zip(hard, model.encode(hard)):
        assert [int(i) for w in words for i in w[1].split()] == library.encode(text, add_special_tokens=False).ids


def test_very_long_words(spark):
    """Words of many kilobytes: the ids of the library, in time that grows with the word."""
    import time

    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(tokenizer_path()), bpe.loaded(tokenizer_path())
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in (513, 3000, 40_000)] + ["a" * 5001, "ab" * 3000, "日本語" * 900, "é" * 700, "the" * 1500]
    for text in (*words, " ".join(words)):
        assert [int(i) for told in next(model.encode([text])) for i in told[1].split()] == library.encode(text, add_special_tokens=False).ids
    start = time.process_time()
    model.merge_long(model.inner[rng.integers(97, 123, 1_000_000)])
    assert time.process_time() - start < 60


def test_encode_then_decode(spark, odd, none):
    path = tokenizer_path()
    encoded = bpe.encode_documents(odd, path)
    assert encoded.where("size(tokens) <> n_tokens").isEmpty() and encoded.where("doc_id = 4").first()["tokens"] == []
    told = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(encoded, path).where("doc_id IS NOT NULL").collect()}
    assert told[13] == "one</w> two</w> three</w>" and told[5] == ""
    assert bpe.decode_documents(bpe.encode_documents(none, path), path).collect() == []


def mixed(df, source_of):
    rows = df.collect()
    by = defaultdict(lambda: [0, 0, 0.0, 0, 0])
    for r in rows:
        s = by[source_of[r["doc_id"], r["size"]]]
        s[0] += r["size"]
        s[1], s[2] = r["source_size"], r["target"]
        s[3] += r["taken"]
        s[4] = max(s[4], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    return by


def test_mix_meets_its_targets(spark, odd, odd_rows, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    size = lambda t: len(brute.SPACE.findall(t or ""))
    for df, rows in ((docs, rows), (odd, [(r[0], r[1], r[3]) for r in odd_rows])):
        report = mixing.mix_report(df)
        by = mixed(report, {(i, size(t)): s for i, t, s in rows})
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += size(t)
        want = brute.targets(sizes)
        for s, (own, told, target, taken, largest) in by.items():
            assert own == told == sizes[s] and target == pytest.approx(want[s])
            assert abs(taken - target) <= largest
        assert sorted(map(str, report.collect())) == sorted(map(str, mixing.mix_report(df.repartition(5)).collect()))
    assert mixing.mix_report(none).collect() == [] and mixing.mix(none).collect() == []


def test_mixed_rows_keep_their_columns(spark, odd):
    got = mixing.mix(odd)
    assert got.columns == odd.columns and got.where("copies <> 7").isEmpty()
    words = sum(len(brute.SPACE.findall(r["text"] or "")) for r in got.collect())
    assert words == sum(r["taken"] for r in mixing.mix_report(odd).collect())


def test_repeated_rows_meet_their_target(spark):
    """Rows that share a doc_id, a text or both, and null ids: the target is met within one row."""
    text = lambda n: "word " * (n % 7 + 1)
    cases = {"same": [(1, "one two three four")] * 1000, "ids": [(1, text(n)) for n in range(700)], "null": [(None, text(n)) for n in range(700)],
             "poor": [(n, "1 2 3 4 5 ###") for n in range(700)]}
    rows = [(i, t, s) for s, some in cases.items() for i, t in some] + [(n, "other words here " * 9, "rest") for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for s, told in mixing.mix(docs).groupBy("source").agg({"text": "count"}).collect():
        assert told > 0
    sizes, targets = defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, report = brute.targets(sizes), mixing.mix_report(docs)
    by = {(r["source_size"], round(r["target"], 6)): r["taken"] for r in report.groupBy("source_size", "target").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    for s, words in sizes.items():
        assert abs(by[words, round(want[s], 6)] - want[s]) <= 27
    assert sorted(map(str, report.collect())) == sorted(map(str, mixing.mix_report(docs.repartition(3)).collect()))


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "1 2 3 ## ") * 5, "ab"[i % 6 > 3]) for i in range(900)], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix_report(docs).where("taken > 0 AND target < source_size").collect():
        taken[r["doc_id"] % 2] += 1
    assert taken[1] > 1.5 * taken[0]


def test_bins_are_entropies():
    data = np.random.default_rng(3).integers(97, 108, 3000).astype(np.uint8)
    bins = fingerprint.entropy_bins(data)
    for i in (0, 1, 700, 2936):
        counts = Counter(data[i:i + 64].tolist()).values()
        want = round(1000 * (-sum(c / 64 * math.log2(c / 64) for c in counts)) / 6)
        assert abs(int(bins[i]) - want) <= 1
    assert (bins[2937:] == -1).all()


def test_blocks_do_not_show(monkeypatch):
    data = np.random.default_rng(4).integers(97, 100, 1500).astype(np.uint8)
    whole = fingerprint._recurrences(data)
    monkeypatch.setattr(fingerprint, "_BLOCK", 200)
    parts = fingerprint._recurrences(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_fingerprints(spark, odd, odd_rows, none, sf_dir):
    assert fingerprint.fingerprint_documents(none).collect() == []
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    order = sorted(rows, reverse=True)
    prints = defaultdict(set)
    for i, after in zip(order, order[1:] + order[:1]):
        text, half = rows[i], len(rows[i]) // 2
        edited = text[:len(text) - half] + rows[after][:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(got[i]["fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in got.values()])
    mine = fingerprint.fingerprint_documents(odd).collect()
    assert len(mine) == len(odd_rows)
    assert [r["fingerprint"] for r in mine if r["n_chars"] == 0] == [""] * sum(not r[1] for r in odd_rows)


def test_fingerprints_equal_brute_force(spark, odd_rows):
    """Features, chains and likeness of every row against loops over single windows; ranks from all windows of the table."""
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + n, t) for n, (_, t, *_) in enumerate(odd_rows) if len(t or "") < 1500]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    data = {i: (t or "").encode() for i, t in rows}
    bins = {i: brute.window_bins(x) for i, x in data.items()}
    seen = Counter(b for some in bins.values() for b in some)
    ranks = [0] * (fingerprint.BINS + 1)
    for n, b in enumerate(sorted(range(fingerprint.BINS + 1), key=lambda b: (seen[b], b))):
        ranks[b] = n
    chain = lambda x: brute.chain(brute.rare_features(x, brute.window_bins(x), ranks))
    text = lambda c: base64.b64encode(b"".join(np.packbits([i in bits for i in range(fingerprint.BITS)]).tobytes() for bits in c)).decode()
    order = sorted(data, reverse=True)
    for i, after in zip(order, order[1:] + order[:1]):
        own, following = dict(rows)[i] or "", dict(rows)[after] or ""
        edited = own[:len(own) - len(own) // 2] + following[:len(own) // 2]
        mine, next_one, other = chain(data[i]), chain(data[after]), chain(edited.encode())
        assert got[i]["fingerprint"] == text(mine) and got[i]["edited_fingerprint"] == text(other)
        assert got[i]["near_next"] == pytest.approx(brute.chain_likeness(mine, next_one), abs=1e-6)
        assert got[i]["near_edited"] == pytest.approx(brute.chain_likeness(mine, other), abs=1e-6)


def test_a_lone_row_is_its_own_next(spark):
    one = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(5)
    text = lambda: "".join(map(chr, rng.integers(97, 123, 6000)))
    a, b = text(), text()
    import pyarrow as pa

    ranks = np.arange(fingerprint.BINS + 1)
    p = fingerprint.fingerprints(pa.array([a, b, a[:4500] + b[:1500], a]), ranks)
    assert fingerprint.likeness(p[0], p[3]) == 1.0
    assert fingerprint.likeness(p[0], p[1]) < 0.1 < fingerprint.likeness(p[0], p[2]) < 1.0
