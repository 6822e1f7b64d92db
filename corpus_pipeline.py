"""From raw documents to packed training sequences, five stages over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift.llm import decontaminate, jaccard, packing, quality, queries, store, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality model keeps."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each class of near copies."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that a document with a smaller doc_id has."""
    return substrings.cleaned(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that benchmark items hit."""
    found = decontaminate.scan(store.bundled(docs), queries.table(spark, sf_dir, "benchmark"), "doc_row")
    return store.unbundled(found.withColumn("text", F.col("cleaned")), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: Expectation-maximisation and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is a written table."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
