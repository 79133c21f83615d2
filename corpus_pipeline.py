"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage works on all that the one before it kept; its decisions take effect. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.functions.cut import written
from auditloom.llm import bpe, decontaminate, jaccard, quality, suffixes
from auditloom.llm.queries import table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur twice; no document goes."""
    return suffixes.cleaned(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark", without_benchmark), ("tokens", token_ids)]

# The stages are not expressible in SQL; tests/llm/test_pipeline.py compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
