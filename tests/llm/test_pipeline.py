"""The five stages end to end and on odd tables."""

import corpus_pipeline
from memloom.llm import jaccard
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        if name != "bpe":
            assert docs.columns == columns
        if name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == set(brute.jaccard_components(rows, 5, 80).values())
        if name == "secrets":
            assert docs.count() == before.count() and all(sum(brute.secrets(r["text"])[0]) == 0 for r in docs.collect())
        if name in ("toxicity", "jaccard_join"):
            assert docs.join(before, columns, "left_anti").isEmpty() and 0 < docs.count() < before.count()
    assert docs.where("n_tokens <> size(tokens)").isEmpty() and docs.count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        columns, rows = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir).persist()
            assert docs.columns == columns
        assert (docs.count() > 0) == (rows > 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0) == (rows > 0)
