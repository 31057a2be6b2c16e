"""Corpus pipeline: five stages applied to `documents`, each written as Parquet and read back.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of
`documents`; the last one returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.llm.decontaminate import contaminated_documents
from surveyframe.llm.jaccard import jaccard_components
from surveyframe.llm.language import keep_identified, learn
from surveyframe.llm.pieces import encode_documents
from surveyframe.llm.storage import small_batches, stored
from surveyframe.llm.substrings import remove_spans


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    small_batches(spark)
    return keep_identified(docs, learn(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    small_batches(spark)
    found = jaccard_components(docs)
    return docs.join(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans leave the texts, emptied documents go."""
    small_batches(spark)
    return remove_spans(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    small_batches(spark)
    found = contaminated_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, encoded."""
    small_batches(spark)
    return encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Byte-pair encoding, hashes over word sequences and tree joins are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
