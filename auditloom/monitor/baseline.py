"""Behavioural baselines per account and the anomalies against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.segmented import micros, range_totals
from auditloom.monitor.patterns import detail
from auditloom.operators.features import gaps

# Event types that open a connection.
CONNECTION_EVENTS = ("database_connection", "db_connect")


@dataclass(frozen=True)
class BaselineConfig:
    learning_hours: int = 72
    min_events: int = 100
    deviation: float = 2.5
    frequency_multiplier: float = 4.0
    duration_multiplier: float = 6.0
    session_limit: int = 5
    query_multiplier: float = 5.0
    new_host_confidence: float = 0.6
    unusual_time_confidence: float = 0.4
    concurrency_span_us: int = 30_000_000


def with_concurrency(events: DataFrame, cfg: BaselineConfig = BaselineConfig(), history: DataFrame | None = None) -> DataFrame:
    """Connection events of the account within +-30 s of each event (at least 1)."""
    out = range_totals(events, ["user_account"], "timestamp",
                       {"concurrent": F.when(F.col("event_type").isin(*CONNECTION_EVENTS), 1).otherwise(0)},
                       cfg.concurrency_span_us, cfg.concurrency_span_us)
    return out.withColumn("concurrent", F.greatest("concurrent", F.lit(1).cast("long")))


def members(events: DataFrame) -> DataFrame:
    """Hosts, databases, commands, hours and weekdays of each account with their counts, one row each.

    Values stay rows: an account may come from any number of hosts.
    """
    kinds = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("source_ip").alias("value")),
        F.struct(F.lit("database").alias("kind"), detail("database").alias("value")),
        F.struct(F.lit("command").alias("kind"), detail("command").alias("value")),
        F.struct(F.lit("hour").alias("kind"), F.hour("timestamp").cast("string").alias("value")),
        F.struct(F.lit("day").alias("kind"), F.weekday("timestamp").cast("string").alias("value")))
    return (events.select("user_account", F.explode(kinds).alias("m")).where("m.value <> ''")
            .groupBy("user_account", "m.kind", "m.value").agg(F.count(F.lit(1)).alias("cnt")))


def command_frequencies(member_rows: DataFrame) -> DataFrame:
    c = member_rows.where("kind = 'command'")
    total = c.groupBy("user_account").agg(F.sum("cnt").alias("_t"))
    return c.join(total, "user_account").select("user_account", F.col("value").alias("command"), (F.col("cnt") / F.col("_t")).alias("frequency"))


def baselines(events: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Scalar baseline and limits of each account. ``events`` needs ``concurrent`` (``with_concurrency``)."""
    d = F.nullif(detail("duration"), F.lit("")).try_cast("double")
    used = F.when(d > 0, d)
    g = events.groupBy("user_account").agg(
        F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("profile_start"), F.max("timestamp").alias("last_seen"),
        F.avg(used).alias("avg_duration"), F.stddev_samp(used).alias("_sd"), F.count(used).alias("_nd"), F.max("concurrent").alias("max_concurrent"))
    m = members(events).groupBy("user_account").agg(
        F.count_if(F.col("kind") == "host").alias("n_hosts"), F.count_if(F.col("kind") == "database").alias("n_databases"),
        F.count_if(F.col("kind") == "command").alias("n_commands"),
        # Hours and weekdays are closed sets of 24 and 7 values.
        F.array_sort(F.collect_list(F.when(F.col("kind") == "hour", F.col("value").cast("int")))).alias("active_hours"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "day", F.col("value").cast("int")))).alias("active_days"))
    hours = (F.unix_micros("last_seen") - F.unix_micros("profile_start")) / F.lit(3.6e9)
    out = g.join(m, "user_account").withColumn("per_hour", F.when(hours > 0, F.col("events") / hours).otherwise(0.0))
    avg = F.coalesce("avg_duration", F.lit(0.0))
    return out.withColumns({
        "avg_duration": avg, "frequency_limit": F.col("per_hour") * F.lit(cfg.frequency_multiplier),
        "duration_limit": F.when(F.col("_nd") > 1, avg + F.lit(cfg.deviation) * F.col("_sd")).otherwise(avg * F.lit(cfg.duration_multiplier)),
        "concurrent_limit": F.greatest("max_concurrent", F.lit(cfg.session_limit).cast("long"))}).drop("_sd", "_nd")


def with_maturity(base: DataFrame, now: Column, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """``established``: enough time, events and variety; ``mature``: the learning phase is over."""
    age_h = (micros(now) - F.unix_micros("profile_start")) / F.lit(3.6e9)
    ok = ((age_h >= 24) & (F.col("n_hosts") > 0) & (F.col("per_hour") > 0) & (F.size("active_hours") >= 2)
          & (F.col("n_commands") >= 1) & (F.col("events") >= cfg.min_events))
    return base.withColumns({"established": ok, "mature": ok & (age_h >= cfg.learning_hours)})


def _known(events: DataFrame, member_rows: DataFrame, kind: str, value: Column, flag: str) -> DataFrame:
    m = member_rows.where(F.col("kind") == kind).select(F.col("user_account").alias("_u"), F.col("value").alias("_v"), F.lit(True).alias(flag))
    return events.join(m, (F.col("user_account") == F.col("_u")) & (value == F.col("_v")), "left").drop("_u", "_v").withColumn(
        flag, F.coalesce(flag, F.lit(False)))


_ANOMALY = ("event_id", "timestamp", "user_account", "anomaly_type", "severity", "confidence", "deviation", "observed")


def _one(cond: Column, kind: str, severity: str, confidence: float, deviation: Column, observed: Column) -> Column:
    return F.when(cond, F.struct(F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
                                 deviation.cast("double").alias("deviation"), observed.alias("observed")))


def learning_anomalies(events: DataFrame, base: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Only clear anomalies while an established baseline is still learning."""
    b = base.where("established and not mature").select("user_account", "concurrent_limit", "n_hosts")
    subnet = F.substring_index("source_ip", ".", 3)
    nets = member_rows.where("kind = 'host'").select("user_account", F.lit("net").alias("kind"), F.substring_index("value", ".", 3).alias("value")).distinct()
    e = _known(events.join(b, "user_account"), nets, "net", subnet, "known_net")
    limit = F.greatest("concurrent_limit", F.lit(5).cast("long"))
    out = F.array_compact(F.array(
        _one(F.col("concurrent") > limit, "excessive_concurrent_sessions", "high", 0.9,
             F.col("concurrent") / F.greatest("concurrent_limit", F.lit(1).cast("long")), F.col("concurrent").cast("string")),
        _one(~F.col("known_net") & (F.col("n_hosts") >= 2), "new_subnet_connection", "high", 0.8, F.lit(1.0), F.col("source_ip"))))
    return e.select("event_id", "timestamp", "user_account", F.explode(out).alias("a")).select("event_id", "timestamp", "user_account", "a.*").select(*_ANOMALY)


def mature_anomalies(events: DataFrame, base: DataFrame, member_rows: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    b = base.where("mature").select("user_account", "concurrent_limit", "active_hours", "active_days")
    e = _known(events.join(b, "user_account"), member_rows, "host", F.col("source_ip"), "known_host")
    e = _known(e, member_rows, "command", detail("command"), "known_command")
    hour, day, cmd = F.hour("timestamp"), F.weekday("timestamp"), detail("command")
    out = F.array_compact(F.array(
        _one(~F.col("known_host"), "new_host_connection", "medium", cfg.new_host_confidence, F.lit(1.0), F.col("source_ip")),
        _one(~F.array_contains("active_hours", hour) | ~F.array_contains("active_days", day), "unusual_time_access", "low",
             cfg.unusual_time_confidence, F.lit(0.8), F.concat_ws("/", hour.cast("string"), day.cast("string"))),
        _one(F.col("concurrent") > F.col("concurrent_limit"), "excessive_concurrent_sessions", "high", 0.8,
             F.col("concurrent") / F.col("concurrent_limit"), F.col("concurrent").cast("string")),
        _one((cmd != "") & ~F.col("known_command"), "unusual_command", "medium", 0.6, F.lit(1.0), cmd)))
    return e.select("event_id", "timestamp", "user_account", F.explode(out).alias("a")).select("event_id", "timestamp", "user_account", "a.*").select(*_ANOMALY)


def anomaly_threats(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        F.concat_ws(":", F.col("event_id").cast("string"), "anomaly_type").alias("detection_id"), "timestamp",
        F.concat(F.lit("behavioral_anomaly_"), "anomaly_type").alias("threat_type"), "severity",
        F.array(F.lit("user_account")).alias("affected_components"),
        F.create_map(F.lit("anomaly_type"), F.col("anomaly_type"), F.lit("observed_value"), F.col("observed"), F.lit("user"), F.col("user_account")).alias("attack_indicators"),
        F.col("confidence").alias("confidence_score"),
        F.array(*[F.lit(a) for a in ("monitor_user_activity", "verify_user_identity", "check_session_validity")]).alias("response_actions"),
        F.array(F.col("event_id").cast("string")).alias("evidence_chain"))


def recent_anomalies(anomalies: DataFrame, now: Column, hours: int = 24, user: str | None = None) -> DataFrame:
    out = anomalies.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return out.where(F.col("user_account") == user) if user else out


# --- account and address statistics ----------------------------------------------------------------------------------
def activity_baseline(events: DataFrame, min_events: int = 10) -> DataFrame:
    """Gaps, lengths, statement classes and hours of each account and address."""
    keys = ["user_account", "source_ip"]
    q = F.lower(detail("query"))
    kind = (F.when(q.contains("select"), "select").when(q.contains("insert"), "insert").when(q.contains("update"), "update")
            .when(q.contains("delete"), "delete").otherwise("other"))
    n = F.when(F.length(detail("query")) > 0, F.length(detail("query")))
    e = gaps(events, keys).withColumn("_k", F.when(n.isNotNull(), kind))
    classes = ("select", "insert", "update", "delete", "other")
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"), F.coalesce(F.avg("gap_sec"), F.lit(0.0)).alias("avg_gap"),
        F.coalesce(F.stddev_samp("gap_sec"), F.lit(0.0)).alias("std_gap"), F.avg(n).alias("avg_length"),
        F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("std_length"),
        *[F.count_if(F.col("_k") == c).alias(f"n_{c}") for c in classes]).where(F.col("event_count") >= min_events)
    hours = events.groupBy(*keys, F.hour("timestamp").alias("h")).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "c")))).alias("hour_counts"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "h"))), 1, 3), lambda s: s["h"]).alias("top_hours"))
    types = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.col(f"n_{c}") for c in classes]))
    return base.withColumn("query_types", F.map_filter(types, lambda k, v: v > 0)).drop(*[f"n_{c}" for c in classes]).join(hours, keys)


def keep_recent_times(events: DataFrame, keys=("user_account", "source_ip"), hours: int = 24) -> DataFrame:
    """Events of the last day of each key, counted from its newest event."""
    newest = events.groupBy(*keys).agg(F.max("timestamp").alias("_max"))
    return events.join(newest, list(keys)).where(F.col("timestamp") >= F.col("_max") - F.expr(f"INTERVAL {hours} HOURS")).drop("_max")


def keep_newest(events: DataFrame, keys=("user_account", "source_ip"), most: int = 1000, keep: int = 500,
                order=("timestamp", "event_id")) -> DataFrame:
    """Keys with more than ``most`` rows keep their newest ``keep``.

    The rank limit runs before the shuffle, so a busy key sends at most ``keep`` rows per task.
    """
    n = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = events.join(n.where(F.col("_n") > most).select(*keys), list(keys), "left_semi")
    small = events.join(n.where(F.col("_n") > most).select(*keys), list(keys), "left_anti")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return small.unionByName(big.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r"))
