"""The rule set. A row rule is a boolean expression, so all of them run in one projection.

Rules that need other rows (shared windows, calendars, places, history) are at the end; each returns
the keys it hit, or the input with one more flag column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions import batched, text
from auditloom.functions.joins import measured
from auditloom.functions.once import keep_where
from auditloom.functions.segmented import HOUR_US, lag_rows, micros, time_slot
from auditloom.sources.geo import locate

ACCESS, INSIDER, TECHNICAL, DESTRUCTION = "ACCESS_ANOMALY", "INSIDER_THREAT", "TECHNICAL_ATTACK", "DATA_DESTRUCTION"
MULTI_TABLE, PROFILE, ML = "MULTI_TABLE_ACCESS", "UNUSUAL_BEHAVIOR", "ML_DETECTED"


@dataclass(frozen=True)
class Rule:
    key: str
    label: str
    group: str
    predicate: Callable[[RuleConfig], Column] | None = None  # None: needs other rows


def _q() -> Column:
    return F.col("query")


def _sensitive(cfg: RuleConfig) -> Column:
    hour = F.hour("timestamp")
    stranger = ~F.col("user").isin(*cfg.sensitive_allowed_users) if cfg.sensitive_allowed_users else F.lit(True)
    return text.contains_any(_q(), cfg.sensitive_tables) & (
        stranger | (hour < cfg.sensitive_safe_hours_start) | (hour >= cfg.sensitive_safe_hours_end))


def created_account(q: Column) -> Column:
    return F.regexp_extract(q, r"(?i)CREATE\s+USER\s+['\"`]?([a-zA-Z0-9_]+)['\"`]?", 1)


def _ghost(cfg: RuleConfig) -> Column:
    name = created_account(_q())
    return text.may_have(_q(), ("CREATE",)) & (name != "") & (~name.isin(*cfg.hr_authorized_users) if cfg.hr_authorized_users else F.lit(True))


def seconds_of_day(clock: str) -> int:
    h, m, s = (clock + ":00").split(":")[:3]
    return int(h) * 3600 + int(m) * 60 + int(float(s))


def time_of_day_us(ts: str = "timestamp") -> Column:
    """Microseconds since midnight of the session's time zone."""
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return whole.cast("long") * 1_000_000 + F.pmod(micros(ts), F.lit(1_000_000))


def is_night(cfg: RuleConfig) -> Column:
    start, end = seconds_of_day(cfg.late_night_start) * 1_000_000, seconds_of_day(cfg.late_night_end) * 1_000_000
    t = time_of_day_us()
    return t.between(start, end) if start <= end else (t >= start) | (t <= end)


def _scan(cfg: RuleConfig) -> Column:
    return (F.col("rows_examined") > cfg.scan_efficiency_min_rows) & (
        F.col("rows_returned") < F.col("rows_examined") * F.lit(cfg.scan_efficiency_min))


RULES: tuple[Rule, ...] = (
    Rule("r01", "Concurrent Login", ACCESS),
    Rule("r02", "Brute-force Success", ACCESS),
    Rule("r03", "Impossible Travel", ACCESS),
    Rule("r04", "Service Account Misuse", INSIDER),
    Rule("r05", "Admin Privilege Abuse", INSIDER,
         lambda c: text.spots_any(_q(), c.admin_keywords) & (F.col("user") != c.admin_exempt_user)),
    Rule("r06", "Sensitive Table Access", INSIDER, _sensitive),
    Rule("r07", "Late Night Query", INSIDER),
    Rule("r08", "Ghost Account Creation", INSIDER, _ghost),
    Rule("r09", "System Table Modification", INSIDER,
         lambda c: (F.col("is_system_table") == 1) & ~_q().rlike(r"(?i)^\s*(SELECT|SHOW|DESC)")),
    Rule("r10", "Insecure Connection", INSIDER,
         lambda c: F.col("user").isin(*c.restricted_connection_users) & (F.col("connection_type") == "TCP/IP")),
    Rule("r11", "SQL Injection", TECHNICAL, lambda c: text.spots_any(_q(), c.sqli_keywords)),
    Rule("r12", "DoS / Resource Exhaustion", TECHNICAL,
         lambda c: F.col("execution_time_ms") > c.execution_time_limit_ms),
    Rule("r13", "High CPU Usage", TECHNICAL, lambda c: F.col("cpu_time_ms") > c.cpu_time_limit_ms),
    Rule("r14", "Scan Efficiency", TECHNICAL, _scan),
    Rule("r15", "Config Change", TECHNICAL, lambda c: text.spots_any(_q(), ("SET GLOBAL", "general_log"))),
    Rule("r16", "High Entropy Query", TECHNICAL, lambda c: F.col("query_entropy") > c.max_query_entropy),
    Rule("r17", "Client Mismatch", TECHNICAL, lambda c: text.has_any(F.col("program_name"), c.disallowed_programs)),
    Rule("r18", "Disk Temp Table Abuse", TECHNICAL, lambda c: F.col("created_tmp_disk_tables") > 0),
    Rule("r19", "Index Evasion", TECHNICAL,
         lambda c: ((F.col("no_index_used") == 1) | (F.col("select_full_join") == 1))
         & (F.col("rows_examined") > c.index_evasion_min_rows)),
    Rule("r20", "Excessive Locking", TECHNICAL, lambda c: F.col("lock_time_ms") > c.lock_time_limit_ms),
    Rule("r21", "Suspicious Comment", TECHNICAL, lambda c: (F.col("has_comment") == 1) & (F.col("is_system_table") == 0)),
    Rule("r22", "Warning Flooding", TECHNICAL, lambda c: F.col("warning_count") > c.warning_count_threshold),
    Rule("r23", "Password Hash Attack", TECHNICAL, lambda c: text.spots_any(_q(), ("authentication_string", "password_expired"))),
    Rule("r24", "JSON Data Extraction", TECHNICAL, lambda c: text.spots_any(_q(), ("JSON_EXTRACT", "JSON_UNQUOTE", "->>"))),
    Rule("r25", "Mass Deletion", DESTRUCTION,
         lambda c: F.col("event_name").isin("statement/sql/delete", "statement/sql/drop")
         & (F.col("rows_affected") > c.mass_deletion_rows)),
    Rule("r26", "Old Data Modification", DESTRUCTION, lambda c: _q().rlike("|".join(c.old_data_years))),
    Rule("r27", "Large Data Dump", DESTRUCTION,
         lambda c: (F.col("rows_returned") > c.large_dump_rows) & text.spots_any(_q(), c.large_dump_tables)),
    Rule("r28", "Audit Log Manipulation", DESTRUCTION,
         lambda c: F.col("event_name").isin("statement/sql/delete", "statement/sql/update", "statement/sql/truncate")
         & text.spots_any(_q(), ("general_log", "audit_log", "slow_log", "history"))),
    Rule("r29", "Hidden View / Rename", DESTRUCTION, lambda c: text.may_have(_q(), ("RENAME", "VIEW")) & _q().rlike(r"(?i)RENAME\s+TABLE|CREATE\s+VIEW")),
    Rule("r30", "Multi-Table Access", MULTI_TABLE),
)
RULE_BY_KEY = {r.key: r for r in RULES}


def with_entropy(df: DataFrame) -> DataFrame:
    """``query_entropy`` as sent by the publisher, computed where it is missing."""
    given = F.col("query_entropy")
    return df.withColumn("query_entropy", F.coalesce(given, batched.entropy(F.when(given.isNull(), F.col("query")))))


def with_row_rules(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """One boolean column per row rule, in one projection."""
    return df.withColumns({r.key: F.coalesce(r.predicate(cfg), F.lit(False)) for r in RULES if r.predicate})


def concurrent_login_windows(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """(user, window) with more than the allowed number of addresses.

    The distinct step combines on the map side, so a busy user ships one row per address and window.
    """
    win = F.window("timestamp", cfg.concurrent_window).getField("start").alias("window_start")
    return (df.select("user", win, "client_ip").distinct().groupBy("user", "window_start")
            .agg(F.count(F.lit(1)).alias("n_ips")).where(F.col("n_ips") > cfg.concurrent_ips_limit))


def brute_force_addresses(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Addresses with too many failures in one window."""
    win = F.window("timestamp", cfg.brute_force_window)
    return (df.where("error_code <> 0").groupBy("client_ip", win).count()
            .where(F.col("count") > cfg.brute_force_attempts).select("client_ip").distinct())


def brute_force_success(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    ok = df.where((F.col("error_code") == 0) & F.col("event_name").isin(*cfg.connect_events))
    return ok.join(brute_force_addresses(df, cfg), "client_ip", "left_semi")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(h))


def impossible_travel(df: DataFrame, geo_ranges: DataFrame, cfg: RuleConfig, slot_us: int = HOUR_US) -> DataFrame:
    """Located rows that are too far from the user's previous located row for the time between."""
    located = locate(df, geo_ranges).where("lat is not null")
    order = ["timestamp", "event_id"]
    steps = lag_rows(located, ["user"], order, ["lat", "lon", "timestamp"], time_slot("timestamp", slot_us))
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    hours = (micros("timestamp") - micros("prev_timestamp")) / F.lit(3.6e9)
    return (steps.withColumn("distance_km", km).withColumn("hours", hours)
            .where((F.col("hours") > 0) & (F.col("distance_km") > cfg.impossible_travel_min_km))
            .withColumn("speed_kmh", F.col("distance_km") / F.col("hours"))
            .where(F.col("speed_kmh") > cfg.impossible_travel_speed_kmh))


def _shifts(overtime: DataFrame, with_ip: bool) -> DataFrame:
    """Tickets with their times as microseconds of the day, read once per ticket and not once per pair of row and ticket."""
    def us(c: str) -> Column:
        parts = F.split(F.col(c), ":")
        return (parts[0].cast("long") * 3600 + parts[1].cast("long") * 60
                + F.coalesce(F.get(parts, 2).cast("long"), F.lit(0))) * 1_000_000
    ip = [F.trim(F.coalesce(F.col("ip"), F.lit(""))).alias("ip")] if with_ip else []
    return overtime.select("user", "date", us("start").alias("start"), us("end").alias("end"), *ip).distinct()


def _inside_shift() -> Column:
    """Time of day within a ticket; a ticket that ends before it starts runs past midnight."""
    start, end, t = F.col("o.start"), F.col("o.end"), F.col("d._clock")
    return F.when(start <= end, t.between(start, end)).otherwise((t >= start) | (t <= end))


def _ticket_match(check_ip: bool) -> Column:
    # Equality on user and day keeps this a hash join however long the calendar grows.
    cond = ((F.col("d.user") == F.col("o.user")) & (F.col("d._day") == F.col("o.date"))
            & F.coalesce(_inside_shift(), F.lit(False)))
    if check_ip:
        cond = cond & ((F.col("o.ip") == "") | (F.col("o.ip") == F.col("d.client_ip")))
    return cond


def _by_ticket(df: DataFrame, overtime: DataFrame, check_ip: bool, how: str) -> DataFrame:
    rows = df.withColumns({"_day": F.to_date("timestamp"), "_clock": time_of_day_us()})
    return rows.alias("d").join(_shifts(overtime, check_ip).alias("o"), _ticket_match(check_ip), how).drop("_day", "_clock")


def without_ticket(df: DataFrame, overtime: DataFrame, check_ip: bool) -> DataFrame:
    return _by_ticket(df, overtime, check_ip, "left_anti")


def with_ticket(df: DataFrame, overtime: DataFrame, check_ip: bool) -> DataFrame:
    return _by_ticket(df, overtime, check_ip, "left_semi")


def service_wrong_ip(cfg: RuleConfig) -> Column:
    out = F.lit(False)
    for user, acc in cfg.service_accounts.items():
        out = out | ((F.col("user") == user) & ~F.col("client_ip").isin(*acc.allowed_ips))
    return out


def service_wrong_hour(cfg: RuleConfig) -> Column:
    out = F.lit(False)
    for user, acc in cfg.service_accounts.items():
        out = out | ((F.col("user") == user) & ~F.hour("timestamp").isin(*acc.allowed_hours))
    return out


def service_account_misuse(df: DataFrame, overtime: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Service accounts from a wrong address, or at a wrong hour without a ticket."""
    late = without_ticket(df.where(service_wrong_hour(cfg) & ~service_wrong_ip(cfg)), overtime, check_ip=False)
    return df.where(service_wrong_ip(cfg)).unionByName(late)


def late_night(df: DataFrame, overtime: DataFrame, cfg: RuleConfig) -> DataFrame:
    return without_ticket(df.where(is_night(cfg)), overtime, check_ip=True)


def multi_table_candidates(df: DataFrame) -> DataFrame:
    """Rows that read tables, with these; a column ``tables`` that is there already is taken."""
    if "tables" in df.columns:
        return df.where(F.size("tables") > 0)
    rows = df.where(_q().rlike("(?i)SELECT|SHOW|DESCRIBE"))
    return keep_where(rows, {"tables": text.touched_tables(_q())}, lambda r: F.size(r["tables"]) > 0)


def multi_table_windows(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """(user, window) that touch more than the allowed number of distinct tables."""
    win = F.window("timestamp", f"{cfg.multi_table_window_minutes} minutes").getField("start").alias("window_start")
    return (multi_table_candidates(df).select("user", win, F.explode("tables").alias("table")).distinct()
            .groupBy("user", "window_start").agg(F.count(F.lit(1)).alias("n_tables"))
            .where(F.col("n_tables") > cfg.multi_table_min_count))


def multi_table_rows(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    win = F.window("timestamp", f"{cfg.multi_table_window_minutes} minutes").getField("start")
    return (multi_table_candidates(df).withColumn("window_start", win)
            .join(measured(multi_table_windows(df, cfg).select("user", "window_start")), ["user", "window_start"], "left_semi"))


def high_entropy_rows(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Rows of the entropy rule; an entropy that is missing is computed once."""
    value = F.coalesce("query_entropy", text.entropy(_q()))
    return keep_where(df, {"entropy": value}, lambda r: r["entropy"] > cfg.max_query_entropy)


def learn_profile(df: DataFrame) -> DataFrame:
    """Hour-of-day habit per user."""
    return df.groupBy("user", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("timestamp").alias("last_seen"))


def merge_profile(old: DataFrame, new: DataFrame, now: Column | None = None, ttl_days: int | None = None) -> DataFrame:
    """Add new counts to the stored ones. A user unseen for the whole TTL is forgotten."""
    cols = ["user", "hour", "cnt", "last_seen"]
    both = old.select(*cols).unionByName(new.select(*cols))
    merged = both.groupBy("user", "hour").agg(F.sum("cnt").alias("cnt"), F.max("last_seen").alias("last_seen"))
    if now is None or ttl_days is None:
        return merged
    fresh = merged.groupBy("user").agg(F.max("last_seen").alias("_seen")).where(
        F.col("_seen") > now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    return merged.join(fresh, "user", "left_semi")


def rare_hours(df: DataFrame, profile: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Rows at an hour the user has rarely worked; ``profile`` must not contain these rows yet."""
    p = profile.select("user", "hour", "cnt")
    return (df.withColumn("hour", F.hour("timestamp")).join(p, ["user", "hour"], "left")
            .where(F.coalesce("cnt", F.lit(0)) < cfg.min_occurrences_threshold).drop("cnt"))
