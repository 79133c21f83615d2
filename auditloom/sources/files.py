"""Files and message streams that hold audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.once import keep_where
from auditloom.schema import AUDIT_SCHEMA, conform

CSVLOG_COLUMNS = ("log_time", "user_name", "database_name", "process_id", "connection_from", "session_id",
                  "session_line_num", "command_tag", "session_start_time", "virtual_transaction_id", "transaction_id",
                  "error_severity", "sql_state_code", "message")
CSVLOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSVLOG_COLUMNS])
STATEMENT_PREFIX = "statement: "
# Format of an action log line.
ACTION_LINE = r"^([\d\-\s:,]+) - ACTION:\s(.*?)\s\|\sTARGET:\s(.*?)\s\|\sREASON:\s(.*)$"


def read_pg_csvlog(spark: SparkSession, path: str) -> DataFrame:
    """csvlog files; quoted fields may span lines, shorter records are dropped."""
    raw = spark.read.csv(path, schema=CSVLOG_SCHEMA, multiLine=True, mode="PERMISSIVE", escape='"')
    return pg_statements(raw)


def pg_statements(raw: DataFrame) -> DataFrame:
    """Statement messages of csvlog records."""
    m = F.col("message")
    return raw.where(m.startswith(STATEMENT_PREFIX)).select(
        F.try_to_timestamp(F.regexp_replace("log_time", r" [A-Z]{3}$", "")).alias("timestamp"), F.col("user_name").alias("user"),
        F.when(F.coalesce("connection_from", F.lit("")) == "", "N/A").otherwise(
            F.split_part("connection_from", F.lit(":"), F.lit(1))).alias("client_ip"),
        F.col("database_name").alias("database"), F.trim(F.substring(m, len(STATEMENT_PREFIX) + 1, 2_000_000_000)).alias("query"))


def stream_text(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files as they appear, for logs that are closed when they arrive. ``tail.stream_lines`` follows files that grow."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_staging(spark: SparkSession, path: str, archive: str | None = None, max_files: int = 1000,
                   schema: T.StructType = AUDIT_SCHEMA) -> DataFrame:
    """Staging Parquet as a stream; processed files move to ``archive``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return conform(reader.parquet(path))


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """All staged Parquet; files may differ in columns, rows without a readable time are dropped."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def parse_messages(df: DataFrame, value: Column | None = None) -> DataFrame:
    """JSON messages to audit records. Works on batch frames and on Kafka or file streams."""
    v = F.col("value").cast("string") if value is None else value
    # The time stays text until conform reads it, so one bad stamp drops one row.
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType) for f in AUDIT_SCHEMA.fields])
    return conform(df.select(F.from_json(v, schema).alias("r")).where("r is not null").select("r.*"))


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Audit records of a topic, from its end on the first start; ``max_offsets`` bounds a batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest")
    return parse_messages((reader if max_offsets is None else reader.option("maxOffsetsPerTrigger", max_offsets)).load())


def jdbc_partitions(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, parts: int) -> DataFrame:
    """A database table read in parallel ranges; filters on it are pushed to the server."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).load())


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Labelled data set in time order."""
    text_time = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType) for f in schema.fields])
    raw = spark.read.csv(path, schema=text_time, header=True, escape='"', multiLine=True)
    return conform(raw).orderBy("timestamp")


# Fields of an audit trail entry; details stay text.
TRAIL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "log_type", "entry_id", "timestamp", "event_id", "event_type", "source_ip", "user_account", "target_component",
    "component", "action_details", "details", "data_id", "integrity_hash", "_bad")] + [T.StructField("risk_score", T.DoubleType())])


def trail_entries(lines: DataFrame) -> DataFrame:
    """JSON lines (``value``) as entries: header lines and unreadable lines are left out."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = keep_where(lines, {"e": F.from_json("value", TRAIL_SCHEMA, opts)}, lambda r: (
        r["e"]["_bad"].isNull() & r["e"]["log_type"].isNull() & r["e"]["entry_id"].isNotNull()))
    other = [c for c in lines.columns if c != "value"]
    return parsed.select(*other, "e.*").drop("_bad", "log_type")


def read_audit_trail(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """Newest entries of a trail."""
    return trail_entries(spark.read.text(path)).orderBy(F.desc("timestamp")).limit(limit)


def action_entries(lines: DataFrame) -> DataFrame:
    line = F.trim("value")
    fields = ("timestamp", "action", "target", "reason")
    other = [c for c in lines.columns if c != "value"]
    return lines.where(line.rlike(ACTION_LINE)).select(
        *other, *[F.trim(F.regexp_extract(line, ACTION_LINE, i + 1)).alias(f) for i, f in enumerate(fields)])


def read_action_log(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Newest ``limit`` actions by line order."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    return action_entries(lines).orderBy(F.desc("at")).limit(limit).drop("at")
