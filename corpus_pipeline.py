"""From raw documents to packed sequences: quality rules, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` applies them in order and writes each stage's rows as Parquet before the next.
``doc_id`` identifies a document; rows that share one and its text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stage, table
from textloom.llm.exact import unique_texts
from textloom.llm.mixing import mix, take
from textloom.llm.packing import pack
from textloom.llm.quality import calibrate, features, keep_good, labelled
from textloom.llm.simhash import one_of_each
from textloom.llm.tokens import tokenizer_path

#: Shares of the token total that the mixing stage aims at.
TARGET = {"clean": 1.0, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language."""
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, calibrate(features(labelled(docs, labels), keyed=True), labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts (null and empty ones are equal); of rows that tie, one."""
    return unique_texts(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8; of rows that tie, one."""
    return one_of_each(docs, width=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted copies say, once at most: the target is the expected tokens of clean text, and none of toxic text.

    Rows that share id and text are taken alike; without labels, all are taken.
    """
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("toxic") == 0, "clean")
    rated, _ = mix(docs, table(spark, sf_dir, "labels"), domain, TARGET, total="clean", cap=1.0)
    return take(docs, rated)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicate_groups),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints, classifier and packing can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
