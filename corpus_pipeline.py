"""The corpus pipeline: documents through five operators, each stage's rows a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bytebpe, mixing, quality, simhash, toxicity
from factloom.llm.common import table, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the weakly supervised rules keep."""
    return quality.keep_good(docs)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the stage's own labelled rows, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.keep_one(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens and digests of its ids and of what they decode to."""
    return bytebpe.round_trips(docs)


STAGES = [("quality", _quality), ("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("mixing", _mixing), ("encoding", _encoding)]

#: SQL can't express the expectation-maximisation, the fingerprints' hash, the cube method or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage_{name}")
    return docs
