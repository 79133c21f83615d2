"""Registered queries of this subpackage and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import arc, bpe, chat, collocations, decontaminate, jaccard, langid, pivots, quality, sampling, substring, suffixes, toxicity

QueryFn = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary()).drop("token_ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.compared(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.clusters(table(spark, sf_dir, "embeddings"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.planted(table(spark, sf_dir, "conversations"))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_bpe, op2_quality, op3_jaccard, op4_suffixes, op5_language, op6_toxicity, op7_fingerprints, op8_substrings, op9_decontamination, op10_warc,
    op11_centroids, op12_chat, op13_collocations)}

SQL: dict[str, str] = {
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100""",
    "op11_centroids": pivots.sql(),
    "op12_chat": chat.SQL,
    "op13_collocations": collocations.SQL,
}
