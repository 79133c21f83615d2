"""Tamper evidence: keyed hashes of records, file checksums, violations and retention."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.once import keep_where
from auditloom.sources.files import TRAIL_SCHEMA


def with_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the padded key as ``_inner`` and ``_outer``.

    The pads are values of a one-row table, which plans and event logs name but do not print; as literals they would tell the key.
    """
    k = key.encode()
    k = hashlib.sha256(k).digest() if len(k) > 64 else k
    k = k.ljust(64, b"\0")
    pads = df.sparkSession.createDataFrame([(bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k))], "i binary, o binary")
    return df.withColumns({"_inner": pads.select("i").scalar(), "_outer": pads.select("o").scalar()})


def hmac_sha256(message: Column) -> Column:
    """HMAC-SHA256 of a text as hex, with built-in hash functions only, for rows ``with_key``."""
    digest = F.unhex(F.sha2(F.concat("_inner", F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat("_outer", digest), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """The fields as JSON with sorted names; missing fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def sign(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return with_key(df, key).withColumn("integrity_hash", hmac_sha256(canonical_json(columns))).drop("_inner", "_outer")


def signed_lines(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Entries as trail lines."""
    signed = sign(df, columns, key)
    return signed.withColumn("value", F.to_json(F.struct(*[F.col(c) for c in sorted([*columns, "integrity_hash"])])))


def verify_trail(lines: DataFrame, columns: Sequence[str], key: str, number: str = "line") -> DataFrame:
    """Bad lines of a trail: corrupted, without hash, or with a hash that does not fit."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = keep_where(lines.select(number, "value"), {"e": F.from_json("value", TRAIL_SCHEMA, opts)},
                        lambda r: r["e"]["log_type"].isNull() | r["e"]["_bad"].isNotNull())
    e = parsed.select(number, F.col("e._bad").alias("_bad"), F.col("e.integrity_hash").alias("integrity_hash"),
                      *[F.col(f"e.{c}").alias(c) for c in columns])
    no = F.col(number).cast("string")
    # The texts of findings.
    error = (F.when(F.col("_bad").isNotNull(), F.concat(F.lit("Corrupted entry at line "), no))
             .when(F.coalesce("integrity_hash", F.lit("")) == "", F.concat(F.lit("Missing integrity hash at line "), no))
             .when(hmac_sha256(canonical_json(columns)) != F.col("integrity_hash"), F.concat(F.lit("Integrity verification failed at line "), no)))
    return keep_where(with_key(e, key), {"error": error}, lambda r: r["error"].isNotNull()).select(number, "error")


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Checksum, size and change time of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(
        "path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))


def compare_checksums(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``path``, ``checksum`` before and now: changed, missing and new files."""
    b, c = baseline.select("path", F.col("checksum").alias("expected")), current.select("path", F.col("checksum").alias("actual"))
    j = b.join(c, "path", "full_outer")
    change = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "new").when(F.col("expected") != F.col("actual"), "changed")
    return j.withColumn("change", change).where("change is not null")


def violations(changes: DataFrame) -> DataFrame:
    """Integrity violations with a severity by what is affected."""
    area = F.when(F.col("path").contains("config"), "config").when(F.col("path").contains("audit_log"), "audit_log").otherwise("file")
    kind = F.concat_ws("_", area, "change")
    high = F.col("violation_type").contains("config") | F.col("violation_type").contains("audit_log")
    return changes.where("change <> 'new'").withColumn("violation_type", kind).withColumn("severity", F.when(high, "HIGH").otherwise("MEDIUM"))


def violation_counts(v: DataFrame, now: Column) -> DataFrame:
    return v.agg(F.count(F.lit(1)).alias("total_violations"), F.count_if(F.col("timestamp") > now - F.expr("INTERVAL 24 HOURS")).alias("recent_violations"))


def retained(df: DataFrame, now: Column, days: float) -> DataFrame:
    """Rows younger than the retention."""
    return df.where(F.col("timestamp") >= now - F.expr(f"make_dt_interval(0, 0, 0, {days} * 86400)"))


def retained_backups(backups: DataFrame, now: Column, days: int = 90, newest: int = 10) -> DataFrame:
    """Backups of the retention time, and in any case the newest ones."""
    top = backups.orderBy(F.desc("timestamp"), F.desc("backup_id")).limit(newest).select("backup_id")
    young = F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS")
    old = backups.where(~young).join(top, "backup_id", "left_semi")
    return backups.where(young).unionByName(old.select(*backups.columns))


def newest_per(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Newest rows of each key; ranked before the shuffle as well, so no key sends more than n rows per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
