"""Each operator of this folder, applied to its whole table: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordwood.llm import (
    classifier,
    html,
    jaccard,
    leaks,
    licences,
    lm,
    mixing,
    negatives,
    repair,
    repeats,
    rules,
    sharding,
    token_files,
)
from wordwood.llm.common import WORD
from wordwood.sources import read_dataset
from wordwood.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its own name."""
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dataset(spark, f"{sf_dir}/{name}.parquet")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, and which."""
    pairs = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = pairs.groupBy("doc_id", "item_id").agg(
        F.max("shared").alias("shared"), F.max("n_shingles").alias("n_shingles")
    )
    return best.withColumn("containment", F.col("shared") / F.col("n_shingles"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more all documents are like the conversations than like each other."""
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards, and into nine."""
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, sharding.EIGHT, sharding.grown(sharding.EIGHT))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the line rules on all documents."""
    verdicts = rules.clean(table(spark, sf_dir, "documents"), cleaned=False)
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_words",
    )


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, net)


@query
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents, as files of their source and language.

    Documents in which lines that speak of a licence hold half of the words, or more, count as the licence
    files of their source and language; the others are in folders of 500 ids below. So folders inherit.
    """
    docs = table(spark, sf_dir, "documents")
    speaks = F.rlike("text", F.lit(licences.STATEMENT))
    stating = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(licences.STATEMENT)))
    stated = F.aggregate(stating, F.lit(0), lambda n, line: n + F.regexp_count(line, F.lit(WORD)))
    is_licence = F.when(speaks, 2 * stated >= F.regexp_count("text", F.lit(WORD))).otherwise(False)
    folder = F.when(~is_licence, F.floor(F.col("doc_id") / 500).cast("string"))
    files = docs.select(
        "doc_id",
        "text",
        is_licence.alias("is_licence"),
        F.concat_ws("/", "source", "lang", folder, "doc_id").alias("path"),
    )
    return licences.scan(files)


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of all documents."""
    groups = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier elsewhere."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


# The vocabulary, and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 1


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents as files, and what these hold."""
    path = scratch_path(spark, "token-files")
    vocabulary = public_tokenizers.path(VOCABULARY)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary, END_ID)
    return token_files.read_token_files(spark, path)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations, once some of their rows are damaged."""
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as the positives of each hundredth vector."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))
