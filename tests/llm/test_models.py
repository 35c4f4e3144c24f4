"""Language and toxicity: exact recursions, held-out accuracy, and odd tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memloom.llm import language, toxicity
from memloom.llm.queries import QUERIES
from tests.llm import brute


def test_chunked_recursions_are_exact():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 130, 64, 0, 200, 5])
    scores, move = rng.normal(size=(400, 3)), rng.normal(size=(3, 3))
    got, at = language.chain_marginals(scores, counts, move), 0
    for n in counts:
        e, step, forward, state = np.exp(scores[at:at + n]), np.exp(move), [], np.ones(3) / 3
        for t in range(n):
            state = (state @ step) * e[t]
            state /= state.sum()
            forward.append(state)
        back = np.ones(3)
        for t in range(n - 1, -1, -1):
            both = forward[t] * back
            assert np.allclose(both / both.sum(), got[at + t])
            back = step @ (e[t] * back)
            back /= back.sum()
        at += n


def test_language_of_held_out_documents(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op1_language"](spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (brute.crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_words_of_switched_text_take_their_own_language():
    a, b = [" ".join(f"{p}{i}{s}" for i in range(60)) for p, s in (("ka", "us"), ("mo", "eni"))]
    model = language.fit([a, b] * 3, ["aa", "bb"] * 3)
    data, offsets = language.flatten(pa.array([a[:200] + " " + b[:200]]))
    starts, ends, counts = language.word_bounds(data, offsets, language.LETTERS)
    hashes = language.span_hash(data)(starts, ends)
    marginal = language.chain_marginals(model.scores(*model.features(data, starts, ends, hashes)), counts, model.move)
    best = marginal.argmax(1)
    half = len(best) // 2
    assert best[:half - 4].mean() < 0.2 and best[half + 4:].mean() > 0.8


def test_languages_of_short_texts_are_learned_beside_long_ones(spark):
    rng = np.random.default_rng(4)
    ends = {"aa": "us", "bb": "eni", "cc": "olo"}
    letters = lambda n, low, high: "".join(chr(c) for c in rng.integers(low, high, n))
    rows = [(lang, " ".join(letters(4, 97, 123) + ends[lang] for _ in range(10 if lang == "cc" else 120))) for lang in ends for _ in range(120)]
    rows += [("dd", letters(30, 0x3042, 0x3094)) for _ in range(120)]  # a text is one word
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    held = [(rows[r["doc_id"]][0], r["lang_pred"]) for r in language.language_report(docs).collect() if r["held_out"]]
    for lang in (*ends, "dd"):
        told = [p for want, p in held if want == lang]
        assert told and sum(p == lang for p in told) >= 0.9 * len(told), (lang, told)


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    got = language.language_report(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and by[4]["score"] == 0 and by[7]["lang_pred"] != "und"
    assert language.language_report(none).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.language_report(unlabelled).first()["lang_pred"] == "und"


def test_the_corrected_risk_finds_what_positives_share():
    rng = np.random.default_rng(2)
    text = lambda bad: np.unique(np.concatenate((rng.integers(1000, 2000, 40), rng.integers(0, 10, 2) if bad else np.zeros(0, np.int64))))
    weights, bias = toxicity.fit([text(True) for _ in range(200)], [text(i % 10 == 0) for i in range(2000)], 0.1)
    assert (weights[:10] > 0.5).all() and abs(weights[1000:2000]).max() < 0.2 and bias < -0.5


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (brute.crc(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, t in held if t], [p for p, t in held if not t]
    assert sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.03 * len(clean)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 0), (10, 1), (None, 1), (11, None), (10, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_report(none, labels).collect() == []
    kept = toxicity.reject_toxic(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_samples_do_not_depend_on_repeats_or_order(spark, sf_dir):
    """Rows that share a doc_id, repeated rows and another order of the table: the same texts teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    again = docs.unionByName(docs.where("doc_id % 3 = 0")).repartition(7)
    one, two = (language.train(d, most_texts=20, sequences=200) for d in (docs, again))
    assert one.languages == two.languages and (one.move == two.move).all()
    assert sorted(one.words.tolist()) == sorted(two.words.tolist())
    models = [toxicity.train(d, labels, most_positive=10, most_unlabelled=40) for d in (docs, docs.repartition(7))]
    assert (models[0][0] == models[1][0]).all() and models[0][1] == models[1][1]
    # A dirty column of languages is a table like any other.
    many = docs.withColumn("lang", F.concat("lang", F.col("doc_id")))
    assert len(language.train(many.limit(60), most_texts=2, sequences=50).languages) > 20
