"""Statement history of a MySQL-like server: ingest, clock anchors, cursors and duplicate removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.functions.records import timer_ms
from auditloom.functions.segmented import HOUR_US, lag_rows, last_known, time_slot

# Connection attributes that are read, with the columns they become.
SESSION_ATTRS = {"program_name": "program_name", "_connector_name": "connector_name", "_os": "client_os",
                 "_source_host": "source_host"}


@dataclass(frozen=True)
class SelfTraffic:
    """What the monitor itself produces and must not see."""

    markers: tuple[str, ...] = ("AUDITLOOM_EVENT", "performance_schema", "audit_store")
    users: tuple[str, ...] = ("audit_monitor",)
    schema: str = "audit_store"


def pivot_session_attrs(attrs: DataFrame) -> DataFrame:
    """One row per session with the four attributes; the smallest value if one is repeated."""
    wide = attrs.groupBy("processlist_id").pivot("attr_name", list(SESSION_ATTRS)).agg(F.min("attr_value"))
    return wide.select("processlist_id", *[F.col(k).alias(v) for k, v in SESSION_ATTRS.items()])


def event_time(boot: Column, timer_ps: Column) -> Column:
    """Boot anchor plus picosecond timer, at microsecond precision."""
    return F.timestamp_micros(F.unix_micros(boot) + F.call_function("div", timer_ps.cast("long"), F.lit(1_000_000)))


def boot_anchors(snapshots: DataFrame, keys=("server",), drift_sec: int = 60, slot_us: int = HOUR_US) -> DataFrame:
    """Boot anchor in force at each status snapshot (``snapshot_ts``, ``uptime_sec``).

    A new epoch starts when the uptime falls or the implied boot time moves by more than the drift;
    its anchor is the boot time its first snapshot implies.
    """
    base = snapshots.withColumn("implied_boot", F.timestamp_micros(
        F.unix_micros("snapshot_ts") - F.col("uptime_sec") * F.lit(1_000_000)))
    slot = time_slot("snapshot_ts", slot_us)
    seen = lag_rows(base, keys, ["snapshot_ts"], ["uptime_sec", "implied_boot"], slot)
    moved = F.abs(F.unix_micros("implied_boot") - F.unix_micros("prev_implied_boot")) > drift_sec * 1_000_000
    seen = seen.withColumn("restart", F.col("prev_uptime_sec").isNull()
                           | (F.col("uptime_sec") < F.col("prev_uptime_sec")) | moved)
    out = last_known(seen, keys, ["snapshot_ts"], {"boot_anchor": F.when(F.col("restart"), F.col("implied_boot"))}, slot)
    return out.select(*keys, "snapshot_ts", "uptime_sec", "restart", "boot_anchor")


def fingerprint(boot: Column, thread: Column, event: Column, timer: Column) -> Column:
    stamp = F.date_format(boot, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.sha2(F.concat_ws("|", stamp, thread.cast("string"), event.cast("string"), timer.cast("string")), 256)


def ingest_statements(events: DataFrame, threads: DataFrame, attrs: DataFrame, boot: DataFrame,
                      own: SelfTraffic = SelfTraffic()) -> DataFrame:
    """Statement events with their thread and session attributes, without the monitor's own traffic.

    ``boot`` has one row and enters as a scalar. Unknown users and schemas are kept.
    """
    foreign = F.col("sql_text").isNotNull()
    for m in own.markers:
        foreign = foreign & ~F.col("sql_text").contains(m)
    foreign = foreign & (F.col("current_schema").isNull() | (F.col("current_schema") != own.schema))
    who = F.col("processlist_user").isNull() | ~F.col("processlist_user").isin(*own.users)
    joined = (events.where(foreign).join(threads, "thread_id", "left").where(who)
              .join(pivot_session_attrs(attrs), "processlist_id", "left")
              .withColumn("server_boot_time", boot.select("server_boot_time").scalar()))
    return joined.withColumns({
        "event_ts": event_time(F.col("server_boot_time"), F.col("timer_start")),
        "fingerprint": fingerprint(F.col("server_boot_time"), F.col("thread_id"), F.col("event_id"), F.col("timer_start"))})


def dedup_statements(df: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Insert-ignore on (fingerprint, event_ts): first of each key, without keys the target already has."""
    out = df.dropDuplicates(["fingerprint", "event_ts"])
    return out if target is None else out.join(target.select("fingerprint", "event_ts"), ["fingerprint", "event_ts"], "left_anti")


def incremental(df: DataFrame, cursor: str, overlap_sec: int = 10, partition: str | None = None) -> DataFrame:
    """Rows after ``cursor`` minus the overlap. With ``partition`` the day filter prunes folders."""
    start = F.lit(cursor).cast("timestamp") - F.expr(f"INTERVAL {overlap_sec} SECONDS")
    out = df.where(F.col("event_ts") > start)
    return out.where(F.col(partition) >= F.to_date(start)) if partition else out


def incremental_by(df: DataFrame, cursor: dict[str, object], limit: int | None = None, upto: object = None) -> DataFrame:
    """Rows behind a cursor, in its order: columns (id, timer or time, then what tells ties apart) and their last values.

    With a unique last column no row is lost where a page ends inside a tie. A batch is better bounded by ``upto``, the
    last value of the first column, than by ``limit``: a range is read in parallel, a limit needs the global order.
    """
    first, *ties = cursor
    after, same = F.col(first) > F.lit(cursor[first]), F.col(first) == F.lit(cursor[first])
    for c in ties:
        after, same = after | (same & (F.col(c) > F.lit(cursor[c]))), same & (F.col(c) == F.lit(cursor[c]))
    # The plain bound on the first column reaches the source's filters.
    page = df.where((F.col(first) >= F.lit(cursor[first])) & after)
    page = page.where(F.col(first) <= F.lit(upto)) if upto is not None else page
    return page.orderBy(*cursor) if limit is None else page.orderBy(*cursor).limit(limit)


def merge_hot_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot buffer and cold table as one stream of statements; a statement in both appears once."""
    return dedup_statements(hot.unionByName(cold, allowMissingColumns=True))


def to_audit(df: DataFrame, timer_divisor: float = 1e9) -> DataFrame:
    """Ingested statements as audit records (before ``conform``)."""
    q = F.coalesce("sql_text", F.lit(""))
    db = text.resolve_database(F.col("current_schema"), q)
    return df.select(
        F.col("event_ts").alias("timestamp"), "event_id", "event_name",
        F.coalesce("processlist_user", F.lit("unknown")).alias("user"),
        text.client_ip(F.col("processlist_host")).alias("client_ip"), db.alias("database"), q.alias("query"),
        F.length(q).alias("query_length"), F.round(text.entropy(q), 4).alias("query_entropy"),
        text.flag(db.isin("mysql", "sys", "information_schema", "performance_schema")).alias("is_system_table"),
        F.round(F.col("rows_sent") / (F.col("rows_examined") + 1), 6).alias("scan_efficiency"),
        text.flag(text.contains_any(q, ("--", "/*"))).alias("has_comment"),
        timer_ms(F.col("timer_wait"), timer_divisor).alias("execution_time_ms"),
        timer_ms(F.col("lock_time"), timer_divisor).alias("lock_time_ms"),
        F.coalesce("program_name", F.lit("unknown")).alias("program_name"),
        F.coalesce("connector_name", F.lit("unknown")).alias("connector_name"),
        F.coalesce("client_os", F.lit("unknown")).alias("client_os"),
        F.coalesce("source_host", F.lit("unknown")).alias("source_host"),
        F.col("rows_sent").alias("rows_returned"), "rows_examined")
