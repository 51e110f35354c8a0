"""A corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. The classifiers of the first two
stages learn from the labels of the documents that reach them. Stages but the last return the columns of documents.
Null texts are scored as empty ones; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexa.llm import bpe, jaccard, mixing, quality, toxicity
from codexa.llm.store import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("ngram_jaccard", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

#: Trained models and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:  # what the stage before wrote is read no more
            scratch.drop(docs)
        docs = made
    return docs
