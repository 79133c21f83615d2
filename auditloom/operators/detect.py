"""Rule hits composed into labels, anomalies, sessions, lock decisions and alert summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions import text
from auditloom.functions.cut import written
from auditloom.functions.joins import measured, together
from auditloom.functions.segmented import tumbling
from auditloom.operators import rules as R
from auditloom.schema import safe_double, safe_long

ROW_GROUPS = (R.ACCESS, R.INSIDER, R.TECHNICAL, R.DESTRUCTION, R.MULTI_TABLE)
# Which detection set a group is stored under.
SET_NAMES = {R.ACCESS: "rule_access", R.INSIDER: "rule_insider", R.TECHNICAL: "rule_technical",
             R.DESTRUCTION: "rule_destruction", R.PROFILE: "rule_behavior_profile", R.ML: "anomalies_ml"}


def _mark(df: DataFrame, small: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join of unique hit keys as a boolean."""
    return df.join(small.withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


@dataclass(frozen=True)
class Known:
    """What rules over several rows find, as small sides: windows of concurrent logins and of many tables (user,
    window_start), attacking addresses (client_ip), rows that jumped between places (event_id)."""

    logins: DataFrame
    tables: DataFrame
    attackers: DataFrame
    jumps: DataFrame | None = None


def login_window(cfg: RuleConfig) -> Column:
    return tumbling("timestamp", cfg.concurrent_window)


def table_window(cfg: RuleConfig) -> Column:
    return tumbling("timestamp", f"{cfg.multi_table_window_minutes} minutes")


def is_connect(cfg: RuleConfig) -> Column:
    return (F.col("error_code") == 0) & F.col("event_name").isin(*cfg.connect_events)


def _reads() -> Column:
    return F.coalesce(F.col("query").rlike("(?i)SELECT|SHOW|DESCRIBE"), F.lit(False))


def reads_tables() -> Column:
    return _reads() & F.coalesce(text.touches_table(F.col("query")), F.lit(False))


def flag_all(df: DataFrame, cfg: RuleConfig, overtime: DataFrame | None = None,
             geo_ranges: DataFrame | None = None, known: Known | None = None) -> DataFrame:
    """Every rule r01..r30 as a boolean column. ``event_id`` must identify a row; ``known`` replaces what is found in ``df``.

    What joins back to the log is always the rare side: windows and addresses that were hit, rows a
    ticket excuses, jumps between places. Late-night rows, which are many, stay an expression. The sides are found side by
    side, all from one slim table that is written once: texts are parsed for it once, and the log is not read again.
    """
    base = R.with_entropy(df)
    slim = base.select("event_id", "user", "client_ip", "timestamp", "error_code",
                       *([] if known else [F.when(_reads(), text.touched_tables(F.col("query"))).otherwise(F.array().cast("array<string>")).alias("tables")]))
    slim = slim if known else written(slim)

    def side(rows: DataFrame, *keys: str) -> DataFrame:
        return measured(rows.select(*keys).distinct())
    if known is None:
        logins, tables, attackers, rare = together(
            df.sparkSession,
            lambda: side(R.concurrent_login_windows(slim, cfg), "user", "window_start"),
            lambda: side(R.multi_table_windows(slim, cfg), "user", "window_start"),
            lambda: side(R.brute_force_addresses(slim, cfg), "client_ip"),
            lambda: _row_keys(slim, cfg, overtime, None if geo_ranges is None else R.impossible_travel(slim.drop("tables"), geo_ranges, cfg).select("event_id")))
    else:
        logins, tables, attackers, rare = known.logins, known.tables, known.attackers, _row_keys(slim, cfg, overtime, known.jumps)
    out = R.with_row_rules(base, cfg)
    out = _mark(out.withColumn("window_start", login_window(cfg)), logins, ["user", "window_start"], "r01").drop("window_start")
    out = _mark(out, attackers, ["client_ip"], "r02").withColumn("r02", F.col("r02") & is_connect(cfg))
    out = _mark_rows(out, cfg, rare)
    out = _mark(out.withColumn("window_start", table_window(cfg)), tables, ["user", "window_start"], "r30").drop("window_start")
    return out.withColumn("r30", F.col("r30") & reads_tables())


def _row_keys(slim: DataFrame, cfg: RuleConfig, overtime: DataFrame | None, jumps: DataFrame | None) -> DataFrame | None:
    """Rows that r03, r04 and r07 need to know of, flags t (jump), s and n (excused by a ticket): per block of 64 ids, one bit
    for each id. A log with running numbers has few blocks, so the side stays small enough for a broadcast however many rows it
    marks; ids far apart have a block each."""
    slim = slim.select("event_id", "user", "client_ip", "timestamp")
    found = []
    if overtime is not None:
        found.append(R.with_ticket(slim.where(R.is_night(cfg)), overtime, True).select("event_id", F.lit("n").alias("_k")))
        if cfg.service_accounts:
            found.append(R.with_ticket(slim.where(R.service_wrong_hour(cfg)), overtime, False).select(
                "event_id", F.lit("s").alias("_k")))
    if jumps is not None:
        found.append(jumps.select("event_id", F.lit("t").alias("_k")))
    if not found:
        return None
    ids = found[0]
    for f in found[1:]:
        ids = ids.unionByName(f)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place())
    # A flag that no id of the block has stays null.
    return measured(ids.groupBy(_block().alias("_block")).agg(*[F.bit_or(F.when(F.col("_k") == k, bit)).alias(f"_{k}") for k in "nst"]))


def _block() -> Column:
    return F.shiftright(F.col("event_id").cast("long"), 6)


def _place() -> Column:
    """Place of an id in its block, 0 to 63."""
    return F.col("event_id").cast("long").bitwiseAND(F.lit(63).cast("long")).cast("int")


def _mark_rows(out: DataFrame, cfg: RuleConfig, rare: DataFrame | None) -> DataFrame:
    """r03, r04 and r07 with one join on the block of the row key."""
    excused_night = excused_hour = travel = F.lit(False)
    if rare is not None:
        out = out.withColumn("_block", _block()).join(rare, "_block", "left")
        excused_night, excused_hour, travel = (F.coalesce(F.getbit(f"_{k}", _place()) == 1, F.lit(False)) for k in "nst")
    return out.withColumns({
        "r03": travel, "r07": R.is_night(cfg) & ~excused_night,
        "r04": R.service_wrong_ip(cfg) | (R.service_wrong_hour(cfg) & ~excused_hour)}).drop("_block", "_n", "_s", "_t")


def group_flag(group: str) -> Column:
    out = F.lit(False)
    for r in R.RULES:
        if r.group == group:
            out = out | F.col(r.key)
    return out


def group_label(group: str) -> Column:
    """Names of the rules of a group that fired, in rule order."""
    return F.concat_ws("; ", *[F.when(F.col(r.key), F.lit(r.label)) for r in R.RULES if r.group == group])


def label_groups(flags: DataFrame) -> DataFrame:
    """``hit_<group>`` and ``rule_<group>`` columns for the five row groups."""
    out = flags.withColumns({f"hit_{g}": group_flag(g) for g in ROW_GROUPS})
    return out.withColumns({f"rule_{g}": F.when(F.col(f"hit_{g}"), group_label(g)) for g in ROW_GROUPS})


def apply_profile(labelled: DataFrame, profile: DataFrame | None, cfg: RuleConfig) -> DataFrame:
    """Rare-hour flag, only on rows without access, insider or technical hits; ``rare_hour`` is the flag without that."""
    if profile is None:
        return labelled.withColumns({"rare_hour": F.lit(False), f"hit_{R.PROFILE}": F.lit(False)})
    p = profile.select("user", F.col("hour").alias("_h"), F.col("cnt").alias("_cnt"))
    hour = F.hour("timestamp")
    return (labelled.withColumn("_h", hour).join(p, ["user", "_h"], "left")
            .withColumn("rare_hour", F.coalesce("_cnt", F.lit(0)) < cfg.min_occurrences_threshold)
            .withColumn(f"hit_{R.PROFILE}", profile_hit()).drop("_h", "_cnt"))


def profile_hit() -> Column:
    return F.col("rare_hour") & ~(F.col(f"hit_{R.ACCESS}") | F.col(f"hit_{R.INSIDER}") | F.col(f"hit_{R.TECHNICAL}"))


def apply_ml(df: DataFrame, scored: DataFrame | None) -> DataFrame:
    """``scored``: event_id, ml_anomaly_score, is_ml for rows no rule caught."""
    if scored is None:
        return df.withColumns({"ml_anomaly_score": F.lit(None).cast("double"), f"hit_{R.ML}": F.lit(False)})
    s = scored.select("event_id", "ml_anomaly_score", F.col("is_ml").alias(f"hit_{R.ML}"))
    return df.join(s, "event_id", "left").withColumn(f"hit_{R.ML}", F.coalesce(f"hit_{R.ML}", F.lit(False)))


def caught_by_rule() -> Column:
    out = F.col(f"hit_{R.PROFILE}")
    for g in ROW_GROUPS:
        out = out | F.col(f"hit_{g}")
    return out


def finalize(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Final reason (the last source of the order wins), ``is_anomaly`` and one group per row."""
    order = [(g, F.col(f"rule_{g}")) for g in ROW_GROUPS] + [
        (R.PROFILE, F.lit("Rare Access Time (Profile Mismatch)")), (R.ML, F.lit(R.ML))]
    reason = F.coalesce(*[F.when(F.col(f"hit_{g}"), label) for g, label in reversed(order)])
    group = F.coalesce(*[F.when(F.col(f"hit_{g}"), F.lit(g)) for g, _ in reversed(order)])
    return df.withColumns({"unusual_activity_reason": reason, "specific_rule": reason, "behavior_group": group,
                           "is_anomaly": reason.isNotNull()})


@dataclass
class Detection:
    """Result of one detection run; every member is a DataFrame plan over the flagged log."""

    logs: DataFrame
    cfg: RuleConfig

    @property
    def clean(self) -> DataFrame:
        """Rows no rule caught: the input of the model."""
        return self.logs.where(~caught_by_rule())

    @property
    def normal(self) -> DataFrame:
        return self.logs.where(~F.col("is_anomaly"))

    @property
    def anomalies(self) -> DataFrame:
        return event_anomalies(self.logs, self.cfg)

    @property
    def sessions(self) -> DataFrame:
        return multi_table_sessions(self.logs.where(F.col(f"hit_{R.MULTI_TABLE}")), self.cfg)

    @property
    def session_evidence(self) -> DataFrame:
        return session_evidence(self.logs.where(F.col(f"hit_{R.MULTI_TABLE}")), self.cfg)

    @property
    def violations(self) -> DataFrame:
        return violations_per_user(self.logs, self.sessions, self.cfg)

    @property
    def locks(self) -> DataFrame:
        return lock_decisions(self.violations, self.cfg)

    @property
    def alerts(self) -> DataFrame:
        return alert_rollup(self.logs)


def detect(df: DataFrame, cfg: RuleConfig, overtime: DataFrame | None = None, geo_ranges: DataFrame | None = None,
           profile: DataFrame | None = None, scored: DataFrame | None = None, known: Known | None = None) -> Detection:
    """Audit records to a full detection result; the same for a batch and a micro-batch.

    The small sides of the window, address and ticket rules are written and counted when this is called.
    """
    flags, profile = together(df.sparkSession, lambda: flag_all(df, cfg, overtime, geo_ranges, known), lambda: None if profile is None else measured(profile))
    labelled = label_groups(flags)
    return Detection(finalize(apply_ml(apply_profile(labelled, profile, cfg), scored), cfg), cfg)


def event_anomalies(logs: DataFrame, cfg: RuleConfig) -> DataFrame:
    """One row per (row, detection set): the union of six sets from one pass over the log."""
    hour = F.hour("timestamp")
    per_set = []
    for g, name in SET_NAMES.items():
        if g == R.PROFILE:
            kind = F.lit("Rare Access Time (Profile Mismatch)")
            reason = F.concat(F.lit("Access at "), hour.cast("string"),
                              F.lit(f"h is rare (< {cfg.min_occurrences_threshold} times in history)"))
        elif g == R.ML:
            kind, reason = F.lit(name), F.lit(f"Detected by {name}")
        else:
            kind, reason = F.col(f"rule_{g}"), F.lit(f"Detected by {name}")
        score = F.coalesce("ml_anomaly_score", F.lit(1.0)) if g == R.ML else F.lit(1.0)
        per_set.append(F.when(F.col(f"hit_{g}"), F.struct(
            F.substring(kind, 1, 100).alias("anomaly_type"), F.lit(g).alias("behavior_group"),
            score.cast("double").alias("score"), F.substring(reason, 1, 500).alias("reason"))))
    hits = F.filter(F.array(*per_set), lambda x: x.isNotNull())
    return (logs.withColumn("_a", F.explode(hits)).where("timestamp is not null").select(
        "event_id", "timestamp", "user", "client_ip", "database", "query", "_a.*", F.lit("new").alias("status"),
        safe_double(F.col("execution_time_ms")).alias("execution_time_ms"),
        safe_long(F.col("rows_returned")).alias("rows_returned"),
        safe_long(F.col("rows_affected")).alias("rows_affected")))


def session_start(cfg: RuleConfig) -> Column:
    return F.window("timestamp", f"{cfg.session_window_minutes} minutes").getField("start")


def multi_table_sessions(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Multi-table rows per user and window.

    Only distinct table names are gathered into a list; the statements themselves stay rows, see
    ``session_evidence``.
    """
    keys = ["user", "session_start"]
    base = rows.withColumn("session_start", session_start(cfg))
    facts = base.groupBy(*keys).agg(
        F.min_by("client_ip", F.struct("timestamp", "event_id")).alias("client_ip"), F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"), F.count(F.lit(1)).alias("query_count"))
    tables = (base.select(*keys, F.explode(text.touched_tables(F.col("query"))).alias("t")).distinct()
              .groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("tables")))
    out = facts.join(tables, keys).withColumn("distinct_tables_count", F.size("tables"))
    return out.where(F.col("distinct_tables_count") >= cfg.session_min_tables).withColumns({
        "anomaly_type": F.lit("multi_table_access"), "behavior_group": F.lit(R.MULTI_TABLE)})


def session_evidence(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """The statements of each session, one per row, keyed like the session."""
    return rows.select("user", session_start(cfg).alias("session_start"), "timestamp", "event_id", "query")


def session_anomalies(sessions: DataFrame) -> DataFrame:
    """Stored form of the sessions with nested details."""
    n = F.col("distinct_tables_count")
    return sessions.select(
        F.lit("session").alias("scope"), "user", "client_ip", F.lit(None).cast("string").alias("database"),
        "session_start", "start_time", "end_time", "anomaly_type", n.cast("double").alias("severity"),
        F.concat(F.lit("Accessed "), n.cast("string"), F.lit(" tables in short window")).alias("reason"),
        F.struct("tables", "query_count",
                 ((F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)).alias("duration_sec")
                 ).alias("details"))


def violations_per_user(logs: DataFrame, sessions: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Violations of each user over the four row sets (a row counts once per set) and the sessions."""
    sets = [F.col(f"hit_{g}") for g in (R.ACCESS, R.INSIDER, R.TECHNICAL, R.DESTRUCTION)]
    n = sum((s.cast("long") for s in sets[1:]), sets[0].cast("long"))
    rows = logs.where(sets[0] | sets[1] | sets[2] | sets[3]).select(
        "user", n.alias("n"), (sets[2] | sets[3]).alias("critical"))
    per_session = sessions.select("user", F.lit(1).cast("long").alias("n"), F.lit(False).alias("critical"))
    return rows.unionByName(per_session).groupBy("user").agg(
        F.sum("n").alias("total_violation_count"), F.max("critical").alias("critical"))


def lock_decisions(violations: DataFrame, cfg: RuleConfig) -> DataFrame:
    count = F.col("total_violation_count").cast("string")
    return violations.where((F.col("total_violation_count") >= cfg.max_violation_threshold) | F.col("critical")).select(
        "user", "total_violation_count",
        # The texts of lock reasons.
        F.when(F.col("critical"), F.concat(F.lit("CRITICAL VIOLATION (Zero Tolerance) - Count: "), count))
        .otherwise(F.concat(F.lit("Threshold Exceeded - Count: "), count)).alias("lock_reason"))


def safe_locks(locks: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Decisions that may be acted on: none when responses are off, never the admin account."""
    out = locks.where(F.lit(cfg.response_enabled))
    if cfg.admin_user:
        out = out.where(F.col("user") != cfg.admin_user)
    return out.withColumn("reason", F.concat(F.lit("Automatic response: "), F.col("lock_reason")))


def stored_anomaly_flag() -> Column:
    """Flag of a stored log row: set by detection, else by the fallback conditions."""
    def truthy(c: str) -> Column:
        return F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return (truthy("is_anomaly") | (F.coalesce("ml_anomaly_score", F.lit(0.0)) > 0.7) | truthy("is_late_night")
            | truthy("is_potential_dump") | truthy("is_risky_command") | truthy("is_suspicious_func")
            | truthy("is_privilege_change") | truthy("has_error"))


# Alert titles in order of priority.
ALERT_TITLES = ((R.TECHNICAL, "TECHNICAL ATTACKS"), (R.DESTRUCTION, "DATA DESTRUCTION"),
                (R.INSIDER, "INSIDER THREATS"), (R.ACCESS, "ACCESS ANOMALIES"))


def alert_rows(logs: DataFrame) -> DataFrame:
    """Each violating row once, under its most urgent title."""
    title = F.coalesce(*[F.when(F.col(f"hit_{g}"), F.lit(t)) for g, t in ALERT_TITLES])
    rule = F.coalesce(*[F.when(F.col(f"hit_{g}"), F.col(f"rule_{g}")) for g, _ in ALERT_TITLES])
    return logs.withColumn("title", title).where("title is not null").select(
        "title", rule.alias("rules"), "user", "client_ip", "timestamp")


def alert_rollup(logs: DataFrame, extra_keys: tuple = ()) -> DataFrame:
    """Count, time range, rule names and number of targets per title.

    Rule names are a closed set, so the list stays short; targets grow with the data and stay rows in
    ``alert_targets``.
    """
    rows = alert_rows(logs) if "title" not in logs.columns else logs
    keys = ["title", *extra_keys]
    split = F.flatten(F.collect_set(F.split("rules", "; ")))
    targets = rows.select(*keys, "user", "client_ip").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_targets"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.array_sort(F.array_distinct(split)).alias("rules")).join(targets, keys).withColumn(
        "desc", F.concat(F.lit("Detected behaviors: "), F.array_join("rules", ", ")))


def alert_targets(logs: DataFrame) -> DataFrame:
    rows = alert_rows(logs) if "title" not in logs.columns else logs
    return rows.select("title", F.concat_ws("@", "user", "client_ip").alias("target")).distinct()


def merge_alerts(pending: DataFrame) -> DataFrame:
    """Summaries of several batches (title, count, first_time, last_time, rules) merged by title."""
    return pending.groupBy("title").agg(
        F.sum("count").alias("count"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("rules")).withColumn(
        "time_range", F.concat_ws(" - ", F.date_format("first_time", "HH:mm:ss"), F.date_format("last_time", "HH:mm:ss")))


def cooldown_alerts(logs: DataFrame, cfg: RuleConfig) -> DataFrame:
    """At most one summary per title and cool-down window."""
    rows = alert_rows(logs).withColumn(
        "send_window", F.window("timestamp", f"{cfg.alert_cooldown_seconds} seconds").getField("start"))
    return alert_rollup(rows, ("send_window",))
