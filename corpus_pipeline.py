"""A training corpus from raw documents: five stages, each one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confluo.llm import common, mixing, packing, secrets, simhash, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the toxicity field scores at 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets inside texts; every document stays."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or repeatedly."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token identifiers into sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("simhash", distinct), ("secrets", redacted), ("mixing", mixed), ("packing", packed)]

#: SQL has no counterpart for the fitted field, the fingerprints' hash or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
