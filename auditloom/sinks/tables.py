"""Stored forms of logs and anomalies, and the writers for them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql import types as T
from pyspark.sql import Window as W

from auditloom.operators.detect import stored_anomaly_flag
from auditloom.schema import safe_bool, safe_double, safe_long

# Columns of a stored log row by kind.
BOOL_COLS = ("is_late_night", "is_work_hours", "is_select_star", "has_limit", "has_order_by", "has_into_outfile",
             "has_load_data", "has_sleep_benchmark", "is_risky_command", "is_admin_command", "is_potential_dump",
             "is_suspicious_func", "is_privilege_change", "is_system_table", "is_sensitive_access", "is_system_access",
             "has_comment", "has_hex", "has_error")
INT_COLS = ("created_tmp_disk_tables", "created_tmp_tables", "select_full_join", "select_scan", "sort_merge_passes",
            "no_index_used", "no_good_index_used", "error_count", "warning_count", "rows_returned", "rows_examined",
            "rows_affected", "num_tables", "num_joins", "num_where_conditions", "subquery_depth", "query_length",
            "accessed_sensitive_tables", "event_id", "error_code")
FLOAT_COLS = ("execution_time_ms", "lock_time_ms", "query_entropy", "scan_efficiency", "ml_anomaly_score",
              "query_count_5m", "error_count_5m", "total_rows_5m", "data_retrieval_speed",
              "execution_time_ms_zscore", "rows_returned_zscore")
TEXT_COLS = ("user", "client_ip", "connection_type", "database", "query", "normalized_query", "event_name",
             "command_type", "analysis_type", "unusual_activity_reason", "suspicious_func_name", "privilege_cmd_name",
             "error_message", "behavior_group", "specific_rule")


def stored_logs(df: DataFrame) -> DataFrame:
    """Enriched log in its stored form: strict types, nested values as JSON, the final anomaly flag.

    Every column of the form is present; one the input lacks gets the empty value of its kind.
    """
    have = set(df.columns)

    def src(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None)
    cols = [F.col("timestamp").cast("timestamp").alias("timestamp")]
    cols += [safe_bool(src(c)).alias(c) for c in BOOL_COLS]
    cols += [safe_long(src(c)).alias(c) for c in INT_COLS]
    cols += [safe_double(src(c)).alias(c) for c in FLOAT_COLS]
    cols += [src(c).cast("string").alias(c) for c in TEXT_COLS]
    tables = F.to_json("accessed_tables") if "accessed_tables" in have else F.lit(None).cast("string")
    out = df.select(*cols, tables.alias("accessed_tables"), safe_bool(src("is_anomaly")).alias("is_anomaly"))
    return out.withColumn("is_anomaly", stored_anomaly_flag()).withColumn("event_date", F.to_date("timestamp"))


def write_daily(df: DataFrame, path: str, sort: tuple[str, ...] = ("user", "timestamp"), mode: str = "append",
                partition: str = "event_date") -> None:
    """Parquet by day. Rows are sorted inside tasks so that readers can skip row groups by user.

    The rebalance gathers each day into files of the advised size and splits a large day over many,
    instead of one small file per task and day.
    """
    df.hint("rebalance", partition).sortWithinPartitions(partition, *sort).write.mode(mode).option("compression", "snappy").partitionBy(partition).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000) -> None:
    """Append to a database table."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode("append").save()


def write_staging(df: DataFrame, path: str) -> None:
    """Raw records for the batch run; every write adds files with new names."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def live_days(df: DataFrame, today: Column, keep_days: int = 30, partition: str = "event_date") -> DataFrame:
    """Rows inside the retention; the filter on the folder column prunes."""
    return df.where(F.col(partition) >= F.date_sub(today, keep_days))


def expired_days(df: DataFrame, today: Column, keep_days: int = 30, partition: str = "event_date") -> DataFrame:
    """Folders a retention run removes."""
    return df.select(partition).distinct().where(F.col(partition) < F.date_sub(today, keep_days))


def drop_expired(spark: SparkSession, path: str, today: str, keep_days: int = 30, partition: str = "event_date") -> int:
    """Delete the day folders older than the retention; returns how many went."""
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    cutoff = spark.sql(f"SELECT CAST(date_sub(DATE'{today}', {keep_days}) AS STRING) AS d").first().d
    gone = 0
    for st in fs.listStatus(fs_path):
        name = st.getPath().getName()
        if name.startswith(f"{partition}=") and name.split("=", 1)[1] < cutoff:
            gone += bool(fs.delete(st.getPath(), True))
    return gone


FEEDBACK_KEYS = ("timestamp", "user", "query")


def feedback_rows(items: DataFrame, label: Column) -> DataFrame:
    """Labelled items with their key; lists become JSON text."""
    lists = {f.name for f in items.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))}
    cols = [F.to_json(c).alias(c) if c in lists else F.col(c) for c in items.columns]
    key = F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in FEEDBACK_KEYS]))
    return items.select(key.alias("feedback_id"), label.alias("is_anomaly_label"), *cols)


def upsert_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """New feedback replaces old of the same key field by field; fields only one side has are kept.

    ``new`` may hold a key several times: its ``arrival`` decides, later values win.
    """
    both = (old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    cols = [c for c in both.columns if c not in ("feedback_id", "_side")]
    sent = set(new.columns)
    stamp = F.struct("_side", "arrival")
    # A field the new side sends wins even when it is null; other fields keep the old value.
    aggs = [(F.max_by(c, stamp) if c in sent else F.max_by(c, F.when(F.col(c).isNotNull(), stamp))).alias(c) for c in cols]
    return both.groupBy("feedback_id").agg(*aggs)


def ingest_metrics(df: DataFrame, keys: tuple[str, ...], started: str, finished: str) -> DataFrame:
    """Rows inserted and duration of each ingest run."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_inserted"), (
        (F.unix_micros(F.max(finished)) - F.unix_micros(F.min(started))) / F.lit(1000.0)).alias("duration_ms"))


def evidence_payload(kind: Column) -> Column:
    """Context of one anomaly as nested JSON."""
    def num(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    return F.to_json(F.struct(
        F.struct("user", F.col("client_ip").alias("ip"), F.col("program_name").alias("program"), "client_os").alias("identity"),
        F.struct(F.col("timestamp").cast("string").alias("timestamp"), yes("is_late_night")).alias("timing"),
        F.struct(F.col("query").alias("sql"), "command_type", num("query_entropy").alias("entropy")).alias("query_content"),
        F.struct(num("execution_time_ms"), num("cpu_time_ms"), num("lock_time_ms"), whole("rows_returned"),
                 whole("rows_examined"), num("scan_efficiency")).alias("performance_metrics"),
        F.struct(yes("is_admin_command"), yes("is_risky_command"), yes("has_comment"), num("error_count_5m")).alias("security_flags"),
        F.struct(kind.alias("initial_flag"), num("ml_anomaly_score").alias("ml_score")).alias("system_detection")))


def newest_first(keys: tuple[str, ...], by: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by)))


def metered(df: DataFrame, write: Callable[[DataFrame], None], run: str) -> dict:
    """Run ``write`` on ``df`` and tell how it went: rows that were written, milliseconds, and the error of a write that failed.

    The rows are counted by the write itself, as it passes them; the stored table is not read again.
    """
    seen = Observation(f"write-{uuid.uuid4().hex}")
    start = time.monotonic()
    error = None
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    except Exception as e:  # a failed run is a result of its own
        error = type(e).__name__
    rows = 0 if error else int(seen.get["rows"])
    return {"run": run, "rows_inserted": rows, "duration_ms": (time.monotonic() - start) * 1000.0, "error": error}


METERED = "run string, rows_inserted long, duration_ms double, error string"


class IngestListener(StreamingQueryListener):
    """Rows and duration of every micro-batch, as the engine reports them."""

    def __init__(self) -> None:
        self.batches: list[dict] = []
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"run": f"{p.runId}/{p.batchId}", "rows_inserted": p.numInputRows, "duration_ms": float(p.batchDuration), "error": None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(str(event.runId))
