"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage gets what its predecessor kept. All but the last return the columns of their input;
the last one returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordwood.llm import classifier, jaccard, leaks, mixing, sharding
from wordwood.llm.common import written
from wordwood.sources import read_dataset


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dataset(spark, f"{sf_dir}/{name}.parquet")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from these documents' labels."""
    net = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return classifier.without_low_quality(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return leaks.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; a document that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, and its shard once there is one more."""
    return sharding.place(docs, sharding.EIGHT, sharding.grown(sharding.EIGHT))


STAGES = [
    ("quality_classifier", accept_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# SQL cannot train the classifier; the tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
