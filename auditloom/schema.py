"""The canonical audit record and the projection that brings any source to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_UNKNOWN = ("user", "client_ip", "database", "connection_type", "program_name", "connector_name",
                 "client_os", "source_host")
_TEXT_EMPTY = ("event_name", "query")
_LONG_ZERO = ("rows_returned", "rows_examined", "rows_affected", "error_code", "error_count", "has_error",
              "warning_count", "created_tmp_disk_tables", "created_tmp_tables", "select_full_join",
              "select_scan", "sort_merge_passes", "no_index_used", "no_good_index_used")
_DOUBLE_ZERO = ("execution_time_ms", "lock_time_ms", "cpu_time_ms")

AUDIT_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("event_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT_EMPTY + _TEXT_UNKNOWN]
    + [T.StructField(c, T.StringType()) for c in ("normalized_query", "error_message")]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLE_ZERO + ("query_entropy", "scan_efficiency")]
    + [T.StructField(c, T.LongType()) for c in _LONG_ZERO]
    + [T.StructField(c, T.IntegerType()) for c in
       ("query_length", "is_system_table", "is_admin_command", "is_risky_command", "has_comment")]
)


def safe_long(c: Column) -> Column:
    """Integer part of any number-like value; bad, missing and non-finite values become 0."""
    d = c.cast("string").try_cast("double")
    return F.coalesce(F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18)), d.cast("long")), F.lit(0))


def safe_double(c: Column) -> Column:
    """Double value; bad, missing and NaN values become 0.0."""
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def safe_bool(c: Column) -> Column:
    # The texts read as true.
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes", "y", "1.0", "on"), F.lit(False))


def conform(df: DataFrame) -> DataFrame:
    """Add missing audit columns, cast the present ones and apply typed defaults.

    Columns outside the schema are kept; rows without a readable timestamp are dropped. It is one
    projection, so column pruning still reaches the scan.
    """
    have = dict(df.dtypes)
    cols: list[Column] = []
    for f in AUDIT_SCHEMA.fields:
        name = f.name
        if name == "timestamp":
            kind = have.get(name, "string")
            ts = F.col(name) if name in have else F.lit(None).cast("timestamp")
            cols.append((F.try_to_timestamp(ts) if kind == "string" else ts.cast("timestamp")).alias(name))
        elif name not in have:
            cols.append(_default(name, f.dataType).alias(name))
        elif name in _LONG_ZERO:
            cols.append((F.coalesce(F.col(name).cast("long"), F.lit(0)) if have[name] in ("int", "bigint", "smallint")
                         else safe_long(F.col(name))).alias(name))
        elif name in _DOUBLE_ZERO:
            cols.append((F.coalesce(F.col(name), F.lit(0.0)) if have[name] == "double"
                         else safe_double(F.col(name))).alias(name))
        elif name in _TEXT_UNKNOWN + _TEXT_EMPTY:
            cols.append(F.coalesce(F.col(name).cast("string"), _default(name, f.dataType)).alias(name))
        else:
            cols.append(F.col(name).cast(f.dataType).alias(name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in AUDIT_SCHEMA.names]
    return df.select(*cols, *extra).where(F.col("timestamp").isNotNull())


def _default(name: str, dtype: T.DataType) -> Column:
    if name in _TEXT_UNKNOWN:
        return F.lit("unknown")
    if name in _TEXT_EMPTY:
        return F.lit("")
    if name in _LONG_ZERO:
        return F.lit(0).cast("long")
    if name in _DOUBLE_ZERO:
        return F.lit(0.0)
    return F.lit(None).cast(dtype)
