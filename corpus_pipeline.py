"""Clean, deduplicate, mask, mix and tokenise the documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import bpe, jaccard, mixing, secrets, toxicity
from memloom.llm.queries import table, tokenizer_path
from memloom.session import cut_lineage, ship_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the positive-unlabelled classifier."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, part=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and tokens of every row."""
    return bpe.encode_documents(docs, tokenizer_path(), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_alike),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A trained classifier and a vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written once and read by the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
