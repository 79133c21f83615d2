"""Risk scores of connections, statements and table counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.functions.chains import keep_spaced
from auditloom.functions.once import guarded, keep_where
from auditloom.functions.segmented import HOUR_US, lag_rows, last_known, range_totals, time_slot
from auditloom.monitor import library as L


def score(*parts: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds, rounded so that limits compare exactly."""
    total = F.lit(0.0)
    for cond, weight in parts:
        total = total + F.when(cond, weight).otherwise(0.0)
    return F.round(total, 9)


def capped(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def named(*parts: tuple[Column, Column | str]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(n) if isinstance(n, str) else n) for cond, n in parts]))


def matched(content: Column, regexes: Sequence[str], lowered: Column | None = None) -> Column:
    """The patterns that match; ``lowered`` (the text in lower case) lets cheap word tests run first."""
    low = F.lower(content) if lowered is None else lowered
    return F.array_compact(F.array(*[F.when(guarded(content, low, r), F.lit(r)) for r in regexes]))


def level_score(level: Column, critical: float, high: float, medium: float = 0.0) -> Column:
    return F.when(level == "critical", critical).when(level == "high", high).when(level == "medium", medium).otherwise(0.0)


def table_level(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for t, level in L.TABLE_LEVELS.items():
        out = F.when(name == t, level).otherwise(out)
    return out


# --- connections (snapshots of a process list: snapshot_ts, Id, User, Host, db, Command, Time, State) -----------------
def _host() -> Column:
    return F.split_part(F.coalesce("Host", F.lit("")), F.lit(":"), F.lit(1))


def with_user_sessions(snapshots: DataFrame) -> DataFrame:
    """Sessions of the same user in the same snapshot."""
    n = snapshots.groupBy("snapshot_ts", "User").agg(F.count(F.lit(1)).alias("user_sessions"))
    return snapshots.join(n, ["snapshot_ts", "User"])


def connection_risk(snapshots: DataFrame, known_users: Sequence[str], limit: int = 3) -> DataFrame:
    return with_user_sessions(snapshots).withColumn("risk_score", capped(score(
        (~F.col("User").isin(*known_users), 0.5), (~_host().isin(*L.LOCAL_HOSTS), 0.3),
        (F.coalesce(F.col("db").isin(*L.SYSTEM_DATABASES), F.lit(False)), 0.4),
        (F.coalesce(F.col("Command").isin(*L.ADMIN_PROCESS_COMMANDS), F.lit(False)), 0.3), (F.col("user_sessions") >= limit, 0.4))))


def connection_risk_basic(snapshots: DataFrame, known_users: Sequence[str], limit: int = 2) -> DataFrame:
    """Variant with its own session limit and without the database term; compares the full host text."""
    return with_user_sessions(snapshots).withColumn("risk_score", capped(score(
        (~F.col("User").isin(*known_users), 0.5), (~F.col("Host").isin(*L.LOCAL_HOSTS), 0.3),
        (F.col("user_sessions") >= limit, 0.4), (F.coalesce(F.col("Command").isin(*L.ADMIN_PROCESS_COMMANDS), F.lit(False)), 0.3))))


def privileged_account_anomalies(snapshots: DataFrame, account: str, base: DataFrame | None = None) -> DataFrame:
    """Unusual use of the monitor's own account, with the reasons."""
    scored = snapshots if "risk_score" in snapshots.columns else snapshots.withColumn("risk_score", F.lit(0.0))
    mine = with_user_sessions(scored.where(F.col("User") == account)) if "user_sessions" not in scored.columns else scored.where(F.col("User") == account)
    cmds = tuple(c for c in L.ADMIN_PROCESS_COMMANDS if c != "Change user")
    remote, admin = ~F.col("Host").isin(*L.LOCAL_HOSTS), F.coalesce(F.col("Command").isin(*cmds), F.lit(False))
    long, many = F.col("Time") > 3600, F.col("user_sessions") > 2
    out = mine.withColumn("indicators", named(
        (remote, "remote_connection"), (admin, F.concat(F.lit("admin_command:"), F.col("Command"))),
        (long, "long_running_connection"), (many, F.concat(F.lit("multiple_sessions:"), F.col("user_sessions").cast("string")))))
    extra = score((remote, 0.4), (admin, 0.5), (long, 0.3), (many, 0.4))
    return out.where(F.size("indicators") > 0).withColumn("updated_risk", capped(F.round(F.col("risk_score") + extra, 9)))


def connection_lifecycle(snapshots: DataFrame, keys: Sequence[str] = ("server",), slot_us: int = 24 * HOUR_US) -> DataFrame:
    """Opened, updated and closed connections between consecutive snapshots; closed ones with their duration."""
    keys = list(keys)
    times = snapshots.select(*keys, "snapshot_ts").distinct()
    slot = time_slot("snapshot_ts", slot_us)
    chain = lag_rows(times, keys, ["snapshot_ts"], ["snapshot_ts"], slot).withColumnRenamed("prev_snapshot_ts", "prev_ts")
    following = chain.where("prev_ts is not null").select(*keys, F.col("prev_ts").alias("snapshot_ts"), F.col("snapshot_ts").alias("next_ts"))
    rows = (snapshots.select(*keys, "snapshot_ts", "Id", "User", "Host").join(chain, [*keys, "snapshot_ts"])
            .join(following, [*keys, "snapshot_ts"], "left"))
    there = snapshots.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("snapshot_ts").alias("_ts"), F.col("Id").alias("_id"), F.lit(True).alias("_there"))

    def same(ts: str) -> Column:
        cond = (F.col("Id") == F.col("_id")) & (F.col(ts) == F.col("_ts"))
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_{k}"))
        return cond
    plain = [*keys, "snapshot_ts", "Id", "User", "Host", "prev_ts", "next_ts"]
    was = rows.join(there, same("prev_ts"), "left").select(*plain, F.coalesce("_there", F.lit(False)).alias("was_there"))
    both = was.join(there, same("next_ts"), "left").select(*plain, "was_there", F.coalesce("_there", F.lit(False)).alias("stays"))
    opened = last_known(both, [*keys, "Id"], ["snapshot_ts"], {"opened_at": F.when(~F.col("was_there"), F.col("snapshot_ts"))}, slot)
    change = F.array_compact(F.array(
        F.struct(F.when(F.col("was_there"), "updated").otherwise("opened").alias("change"), F.col("snapshot_ts").alias("at"),
                 F.lit(None).cast("double").alias("duration_sec")),
        F.when(~F.col("stays") & F.col("next_ts").isNotNull(), F.struct(
            F.lit("closed").alias("change"), F.col("next_ts").alias("at"),
            ((F.unix_micros("next_ts") - F.unix_micros("opened_at")) / F.lit(1e6)).alias("duration_sec")))))
    return opened.select(*keys, "Id", "User", "Host", F.explode(change).alias("c")).select(*keys, "Id", "User", "Host", "c.*")


def login_failures(connections: DataFrame, limit: int = 5) -> DataFrame:
    """Hosts with many login-state connections shorter than a second within an hour (``ts``, ``host``, ``state``, ``duration_sec``)."""
    short = connections.where((F.col("duration_sec") < 1) & (F.col("state") == "login")).withColumn(
        "host", F.split_part("host", F.lit(":"), F.lit(1)))
    counted = range_totals(short, ["host"], "ts", {"failures": F.lit(1)}, HOUR_US - 1)
    return counted.where(F.col("failures") >= limit).withColumn("risk_score", F.lit(0.9))


# --- statements ------------------------------------------------------------------------------------------------------
def statement_threats(df: DataFrame, audit_table: str = "audit_log", q: str = "query") -> DataFrame:
    """Score, categories and patterns of each statement; rows below 0.3 are left out."""
    c = strip_short(df, q, 10)
    body, low = F.col("_c"), F.col("_low")
    groups = (("malicious_query", 0.3, L.MALICIOUS), ("reconnaissance", 0.4, L.RECONNAISSANCE), ("privilege_escalation", 0.6, L.ESCALATION))
    found = {name: matched(body, regexes, low) for name, _, regexes in groups}
    found |= {"tamper": low.contains(audit_table), "perf": low.contains("performance_schema")}

    def derive(s: Column) -> dict[str, Column]:
        total = F.when(s["tamper"], 0.5).otherwise(0.0) + F.when(s["perf"], 0.4).otherwise(0.0)
        for n, w, _ in groups:
            total = total + F.size(s[n]) * F.lit(w)
        total = F.round(total, 9)
        cats = named(*[(F.size(s[n]) > 0, n) for n, _, _ in groups], (s["tamper"], "audit_log_tampering"), (s["perf"], "performance_schema_access"))
        return {"raw_score": total, "categories": cats, "patterns": F.concat(*[s[n] for n, _, _ in groups]),
                "risk_score": capped(total), "is_high_risk": total >= 0.6}
    return keep_where(c, found, lambda r: (r["raw_score"] >= 0.3) | (F.size(r["patterns"]) > 0), derive).drop("_c", "_low")


def strip_short(df: DataFrame, q: str, shortest: int) -> DataFrame:
    """Trimmed text ``_c`` and its lower case ``_low``; shorter texts are left out."""
    return (df.withColumn("_c", text.strip(F.coalesce(F.col(q), F.lit("")))).where(F.length("_c") >= shortest)
            .withColumn("_low", F.lower("_c")))


def suspicious_statements(df: DataFrame, q: str = "query") -> DataFrame:
    """Scorer whose patterns and words come from settings."""
    c = strip_short(df, q, 1)
    body, low = F.col("_c"), F.col("_low")
    found = {"pats": matched(body, [f"(?i){p}" for p in L.SUSPICIOUS], low),
             "words": named(*[(low.contains(w.lower()), f"privilege_keyword:{w}") for w in L.PRIVILEGE_WORDS]),
             "schema": low.contains("information_schema")}

    def derive(s: Column) -> dict[str, Column]:
        total = F.round(F.size(s["pats"]) * F.lit(0.3) + F.size(s["words"]) * F.lit(0.4) + F.when(s["schema"], 0.5).otherwise(0.0), 9)
        return {"n_patterns": F.size(s["pats"]), "words": s["words"], "raw_score": total, "risk_score": capped(total)}
    return keep_where(c, found, lambda r: r["raw_score"] >= 0.3, derive).drop("_c", "_low", "raw_score")


def counter_query_risk(df: DataFrame, q: str = "query", rows_sent: str = "rows_returned") -> DataFrame:
    """Statements that read server counters: reconnaissance groups, credentials, volume, sensitive names."""
    c = strip_short(df, q, 10)
    body, low = F.col("_c"), F.col("_low")
    found = {name: F.size(matched(body, regexes, low)) for name, _, regexes in L.COUNTER_RECON}
    found["credentials"] = F.size(matched(body, L.CREDENTIALS, low))
    tables = [(t, level) for t, level in L.TABLE_LEVELS.items() if level in ("critical", "high")]
    found["tables"] = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(f"{'critical' if level == 'critical' else 'high_risk'}_table_query:{t}"))
                                                for t, level in tables]))
    found["sent"] = F.col(rows_sent)

    def derive(s: Column) -> dict[str, Column]:
        bulk, large = s["sent"] > 1000, (s["sent"] > 100) & (s["sent"] <= 1000)
        total = s["credentials"] * F.lit(0.8) + F.when(bulk, 0.4).when(large, 0.2).otherwise(0.0)
        for name, risk, _ in L.COUNTER_RECON:
            total = total + s[name] * F.lit(risk)
        critical = F.size(F.filter(s["tables"], lambda t: t.startswith("critical")))
        total = F.round(total + critical * F.lit(0.6) + (F.size(s["tables"]) - critical) * F.lit(0.4), 9)
        names = named(*[(s[n] > 0, n) for n, _, _ in L.COUNTER_RECON], (s["credentials"] > 0, "credential_extraction_attempt"),
                      (bulk, "bulk_data_extraction"), (large, "large_result_set"))
        return {"raw_score": total, "indicators": F.concat(names, s["tables"]), "risk_score": capped(total), "is_high_risk": total >= 0.7}
    return keep_where(c, found, lambda r: (r["raw_score"] >= 0.3) | (F.size(r["indicators"]) > 0), derive).drop("_c", "_low", "raw_score")


def credential_block(df: DataFrame, q: str = "query") -> DataFrame:
    """Statements to block, with the first pattern they match."""
    return keep_where(df, {"pattern": F.get(matched(F.col(q), L.CREDENTIALS), 0)}, lambda r: r["pattern"].isNotNull())


# --- counters (object_name, count_read, count_write, count_fetch, count_insert, count_update, count_delete) -------------
def counter_risk(io: DataFrame) -> DataFrame:
    """Risk of every counter table in use."""
    reads = F.col("count_read") + F.col("count_fetch")
    writes = F.col("count_write") + F.col("count_insert") + F.col("count_update") + F.col("count_delete")
    used = io.where((F.col("object_schema") == "performance_schema")
                    & ((F.col("count_read") > 0) | (F.col("count_write") > 0) | (F.col("count_fetch") > 0)))
    d = used.withColumns({"total_writes": writes, "total_access": reads + writes, "level": table_level(F.col("object_name"))}).where("total_access > 0")
    lvl = F.coalesce("level", F.lit("none"))
    many, some = F.col("total_access") > 1000, (F.col("total_access") > 100) & (F.col("total_access") <= 1000)
    odd = (F.col("total_writes") > 0) & F.col("object_name").isin("accounts", "users", "hosts")
    ind = named((lvl == "critical", "critical_table_access"), (lvl == "high", "high_risk_table_access"),
                (lvl == "medium", "medium_risk_table_access"), (many, "excessive_access_count"), (some, "high_access_count"),
                (odd, "unexpected_write_operations"))
    s = score((lvl == "critical", 0.8), (lvl == "high", 0.6), (lvl == "medium", 0.4), (many, 0.3), (some, 0.2), (odd, 0.5))
    return (d.withColumns({"risk_score": capped(s), "indicators": ind,
                           "access_type": F.when(F.col("total_writes") == 0, "read").otherwise("write")})
            .where((F.col("risk_score") >= 0.4) | (F.size("indicators") > 0)).drop("level"))


def counter_risk_basic(io: DataFrame) -> DataFrame:
    total = F.col("count_read") + F.col("count_write") + F.col("count_misc")
    used = io.where("object_schema = 'performance_schema'").withColumn("total_access", total).where("total_access > 0")
    s = score((F.lower("object_name").isin(*L.SENSITIVE_COUNTERS), 0.6), (F.col("total_access") > 100, 0.3))
    return used.withColumn("risk_score", capped(s)).where("risk_score >= 0.5")


def table_risk(name: Column) -> Column:
    level = table_level(name)
    return F.when(level.isNull(), 0.1).when(level == "critical", 1.0).when(level == "high", 0.8).when(level == "medium", 0.6).otherwise(0.4)


def recon_sessions(access: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Users that walk through sensitive counter tables (``timestamp``, ``user``, ``host``, ``table_name``, ``event_id``)."""
    at = F.struct("timestamp", "event_id")
    d = access.withColumns({"window_start": F.window("timestamp", window).getField("start"), "_r": table_risk(F.col("table_name")),
                            "_s": F.when(table_level(F.col("table_name")).isNotNull(), F.col("table_name"))})
    g = d.groupBy("user", "host", "window_start").agg(
        F.count(F.lit(1)).alias("access_count"), F.countDistinct("_s").alias("sensitive_tables"),
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / F.lit(1e6)).alias("time_span_sec"),
        F.max_by("_r", at).alias("_last"), F.min_by("_r", at).alias("_first")).where("access_count >= 3")
    many, some = F.col("sensitive_tables") >= 3, F.col("sensitive_tables") == 2
    fast = (F.col("time_span_sec") < 60) & (F.col("access_count") >= 5)
    up = F.col("_last") > F.col("_first")
    s = score((many, 0.8), (some, 0.6), (fast, 0.5), (up, 0.4))
    return (g.withColumns({"_p": s, "indicators": named((many, "systematic_sensitive_table_enumeration"), (some, "multiple_sensitive_table_access"),
                                                         (fast, "rapid_fire_access"), (up, "escalating_access_pattern"))})
            .where("_p >= 0.5").withColumn("risk_score", capped(F.col("_p"))).drop("_p", "_last", "_first"))


def escalation_trend(access: DataFrame, keys: Sequence[str], min_events: int = 3) -> DataFrame:
    """Whether the key's last access is riskier than its first."""
    at = F.struct("timestamp", "event_id")
    return (access.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("risk", at).alias("first_risk"), F.max_by("risk", at).alias("last_risk"))
            .withColumn("escalating", (F.col("n") >= min_events) & (F.col("last_risk") > F.col("first_risk"))))


def access_counts(access: DataFrame) -> DataFrame:
    return access.groupBy("table_name", "user").agg(F.sum("access_count").alias("access_count"))


def normal_tables(access: DataFrame, start: Column, period_sec: int = 3600) -> DataFrame:
    """Tables each user touched in the learning period, one row per pair."""
    return access.where((F.col("timestamp") >= start) & (F.col("timestamp") <= start + F.expr(f"INTERVAL {period_sec} SECONDS"))).select(
        "user", "table_name").distinct()


# --- event buffers ---------------------------------------------------------------------------------------------------
def events_between(events: DataFrame, start: Column, end: Column) -> DataFrame:
    return events.where(F.col("timestamp").between(start, end))


def newest_events(events: DataFrame, n: int = 1000) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def event_key() -> Column:
    return F.md5(F.concat_ws(":", "event_type", "source_ip", "user_account", "target_component"))


def drop_repeats(events: DataFrame, ttl_sec: int) -> DataFrame:
    """Events of the same kind, place and account within the TTL of a kept one are dropped."""
    return keep_spaced(events.withColumn("event_key", event_key()), ["event_key"], "timestamp", ttl_sec * 1_000_000, tie="event_id")
