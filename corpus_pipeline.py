"""A training-data pipeline over ``documents``: five stages, each one operator of ``reviewloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import bpe, mixing, quality, simhash, toxicity
from reviewloom.staging import stage, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays; links are five-word shingles at similarity 0.8 or more.

    Candidates are the links of SimHash balls, verified on the shingles; MinHash adds those at 0.8 that lie beyond the balls.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents as often as the mixture uses them, with the columns of documents."""
    return mixing.mixture(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and again decoded texts."""
    return bpe.round_trip(docs, *bpe.default_tokenizer())


STAGES = [("toxicity", civil), ("quality", good), ("near_dedup", near_dedup), ("mixing", mixed), ("bpe", tokens)]

#: SQL can't express the trained models; tests/llm/test_pipeline.py holds every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
