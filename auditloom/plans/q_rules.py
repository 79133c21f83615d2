"""Features, rolling windows, rules and their composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.functions import text
from auditloom.functions.segmented import HOUR_US, lag_rows, time_slot
from auditloom.operators import detect as D
from auditloom.operators import features as FE
from auditloom.operators import rules as R
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import CFG, audit, detection, history_profile, stored


def register(cat: Catalog) -> None:
    _rules(cat)
    _windows(cat)
    _detection(cat)


def _rules(cat: Catalog) -> None:
    names = {
        "r01": "concurrent_login", "r02": "brute_force_success", "r03": "impossible_travel", "r04": "service_account_misuse",
        "r05": "admin_privilege_abuse", "r06": "sensitive_table_access", "r07": "late_night_query", "r08": "ghost_account",
        "r09": "system_table_modification", "r10": "insecure_connection", "r11": "sql_injection", "r12": "dos",
        "r13": "high_cpu", "r14": "scan_efficiency", "r15": "config_change", "r16": "high_entropy",
        "r17": "client_mismatch", "r18": "disk_temp_table", "r19": "index_evasion", "r20": "excessive_locking",
        "r21": "suspicious_comment", "r22": "warning_flood", "r23": "password_hash_attack", "r24": "json_extraction",
        "r25": "mass_deletion", "r26": "old_data_modification", "r27": "large_dump", "r28": "audit_log_manipulation",
        "r29": "hidden_view_rename", "r30": "multi_table_access"}

    def row_rule(key):
        rule = R.RULE_BY_KEY[key]

        def run(spark, sf):
            df = audit(spark, sf)
            hits = R.high_entropy_rows(df, CFG) if key == "r16" else df.where(rule.predicate(CFG))
            return hits.select(
                "event_id", "user", "client_ip", F.lit(rule.label).alias("rule"))
        return run

    special = {
        "r01": lambda sp, sf: (lambda a: a.withColumn("window_start", F.window("timestamp", CFG.concurrent_window)["start"])
                               .join(R.concurrent_login_windows(a, CFG), ["user", "window_start"], "left_semi"))(audit(sp, sf)),
        "r02": lambda sp, sf: R.brute_force_success(audit(sp, sf), CFG),
        "r03": lambda sp, sf: R.impossible_travel(audit(sp, sf), X.geo_ranges(sp, sf), CFG),
        "r04": lambda sp, sf: R.service_account_misuse(audit(sp, sf), X.overtime(sp, sf), CFG),
        "r07": lambda sp, sf: R.late_night(audit(sp, sf), X.overtime(sp, sf), CFG),
        "r30": lambda sp, sf: R.multi_table_rows(audit(sp, sf), CFG),
    }
    layer = {"r03": "geo", "r04": "overtime", "r07": "overtime"}
    for key, name in names.items():
        label = R.RULE_BY_KEY[key].label
        if key in special:
            def run(spark, sf, fn=special[key], label=label):
                return fn(spark, sf).select("event_id", "user", "client_ip", F.lit(label).alias("rule"))
        else:
            run = row_rule(key)
        cat.add(f"{key}_{name}", run, S.sql(layer.get(key, "audit"),
                f"""SELECT event_id, "user", client_ip, '{label}' AS rule FROM audit a WHERE {S.RULE_SQL[key]}"""))

    cat.add("r03_travel_speed", lambda sp, sf: R.impossible_travel(audit(sp, sf), X.geo_ranges(sp, sf), CFG).select(
        "event_id", "user", "distance_km", "hours", "speed_kmh"),
        S.sql("geo", 'SELECT event_id, "user", distance_km, hours, speed_kmh FROM travel'),
        rnd={"distance_km": 4, "hours": 6, "speed_kmh": 2})

    def rare(sp, sf):
        late = audit(sp, sf).where(F.col("timestamp") >= F.lit(X.PROFILE_SPLIT).cast("timestamp"))
        return R.rare_hours(late, history_profile(sp, sf), CFG).select("event_id", "user", "hour")
    cat.add("r31_rare_access_hour", rare, S.sql("profile", """SELECT a.event_id, a."user", hour(a."timestamp") AS hour FROM audit a
        LEFT JOIN profile p ON p."user" = a."user" AND p.hour = hour(a."timestamp")
        WHERE a."timestamp" >= TIMESTAMP '2024-01-16 00:00:00' AND coalesce(p.cnt, 0) < 25"""), ints=("hour",))

    def learn(sp, sf):
        logs = stored(sp, sf).logs
        new = logs.where((F.col("timestamp") >= F.lit(X.PROFILE_SPLIT).cast("timestamp")) & ~F.col(f"hit_{R.TECHNICAL}"))
        return R.merge_profile(history_profile(sp, sf), R.learn_profile(new))
    cat.add("r32_profile_learning", learn, S.sql("det", """SELECT "user", hour("timestamp") AS hour, count(*) AS cnt,
        max("timestamp") AS last_seen FROM det WHERE "timestamp" < TIMESTAMP '2024-01-16 00:00:00' OR NOT h_tec
        GROUP BY ALL"""), ts=("last_seen",), ints=("hour",))
    cat.add("r32_profile_ttl", lambda sp, sf: R.merge_profile(
        history_profile(sp, sf).where("user <> 'user_7'"),
        R.learn_profile(audit(sp, sf).where("user = 'user_7' AND timestamp < '2024-01-02'")),
        F.lit("2024-01-20").cast("timestamp"), 10),
        S.sql("audit", """SELECT "user", hour("timestamp") AS hour, count(*) AS cnt, max("timestamp") AS last_seen FROM audit
        WHERE ("user" <> 'user_7' AND "timestamp" < TIMESTAMP '2024-01-16 00:00:00')
         AND "user" IN (SELECT "user" FROM audit WHERE "timestamp" < TIMESTAMP '2024-01-16 00:00:00'
          GROUP BY "user" HAVING max("timestamp") > TIMESTAMP '2024-01-10 00:00:00') GROUP BY ALL"""),
        ts=("last_seen",), ints=("hour",))


def _windows(cat: Catalog) -> None:
    def prep(sp, sf):
        return FE.preprocess(audit(sp, sf)).withColumns(FE.error_features())
    norm = r"""trim(regexp_replace(regexp_replace(regexp_replace(query, '"\w+"', '"?"', 'g'), '''\w+''', '''?''', 'g'), '\d+', '?', 'g'))"""
    pre = f"""pre AS (SELECT *, CAST(length({norm}) AS BIGINT) AS n, CASE WHEN error_code <> 0 THEN 1 ELSE 0 END AS has_error,
        rows_returned / (execution_time_ms + 0.001::DOUBLE) AS speed FROM audit)"""
    cat.add("w01_rolling_5m", lambda sp, sf: FE.rolling_5m(prep(sp, sf)).select(
        "event_id", "query_count_5m", "error_count_5m", "total_rows_5m", "query_len_std_5m"),
        S.sql("audit", """SELECT event_id, count(*) OVER w AS query_count_5m, sum(has_error) OVER w AS error_count_5m,
         sum(rows_returned) OVER w AS total_rows_5m, coalesce(stddev_samp(n) OVER w, 0.0) AS query_len_std_5m FROM pre
         WINDOW w AS (PARTITION BY "user" ORDER BY epoch_us("timestamp") RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""", pre),
        rnd={"query_len_std_5m": 4}, big=("query_count_5m", "error_count_5m", "total_rows_5m"))
    metrics = {"execution_time_ms": "execution_time_ms", "rows_returned": "rows_returned", "data_retrieval_speed": "speed"}
    z = ", ".join(f"CASE WHEN count(*) OVER w < 3 OR stddev_pop({c}) OVER w = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / "
                  f"stddev_pop({c}) OVER w END AS {m}_zscore" for m, c in metrics.items())
    cat.add("w02_user_zscore", lambda sp, sf: FE.z_scores(prep(sp, sf).withColumn(
        "data_retrieval_speed", FE.retrieval_speed())).select("event_id", *[f"{m}_zscore" for m in metrics]),
        S.sql("audit", f'SELECT event_id, {z} FROM pre WINDOW w AS (PARTITION BY "user")', pre),
        rnd={f"{m}_zscore": 4 for m in metrics})
    gap = """gap AS (SELECT *, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY "user" ORDER BY "timestamp", event_id))) / 1e6 AS g FROM audit)"""
    cat.add("w03_event_gaps", lambda sp, sf: FE.gaps(audit(sp, sf), ["user"]).select("event_id", "user", "gap_sec"),
            S.sql("audit", 'SELECT event_id, "user", g AS gap_sec FROM gap', gap), rnd={"gap_sec": 6})
    cat.add("w03_gap_summary", lambda sp, sf: FE.gap_summary(audit(sp, sf), ["user"]),
            S.sql("audit", """SELECT "user", count(g) AS n, avg(g) AS mean, stddev_samp(g) AS std, min(g) AS min, max(g) AS max,
             quantile_cont(g, 0.25) AS p25, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.75) AS p75 FROM gap
             WHERE g IS NOT NULL GROUP BY "user" """, gap),
            rnd={c: 4 for c in ("mean", "std", "min", "max", "p25", "p50", "p75")})
    reg = """gap AS (SELECT "user", client_ip, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY "user", client_ip ORDER BY "timestamp", event_id))) / 1e6 AS g FROM audit),
        st AS (SELECT "user", client_ip, count(*) AS n_gaps, avg(g) AS mean_gap, stddev_samp(g) AS std_gap FROM gap WHERE g IS NOT NULL GROUP BY ALL)"""
    cat.add("w04_gap_regularity", lambda sp, sf: FE.gap_regularity(audit(sp, sf), ["user", "client_ip"], tolerance=1.0, min_ratio=0.9),
            S.sql("audit", """SELECT s."user", s.client_ip, any_value(n_gaps) AS n_gaps, any_value(mean_gap) AS mean_gap, any_value(std_gap) AS std_gap,
             avg(CASE WHEN abs(g - mean_gap) < std_gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS regularity,
             avg(CASE WHEN abs(g - mean_gap) < std_gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.9 AND any_value(n_gaps) >= 9 AS is_regular
             FROM gap JOIN st s ON s."user" = gap."user" AND s.client_ip = gap.client_ip WHERE g IS NOT NULL GROUP BY s."user", s.client_ip""", reg),
            rnd={"mean_gap": 4, "std_gap": 4, "regularity": 6})
    cat.add("w05_concurrent_sessions", lambda sp, sf: FE.concurrent_sessions(
        audit(sp, sf), F.col("connection_type") == "TCP/IP", ("user",), 600_000_000).select("event_id", "user", "concurrent_sessions"),
        S.sql("audit", """SELECT event_id, "user", count(*) OVER (PARTITION BY "user" ORDER BY epoch_us("timestamp")
         RANGE BETWEEN 600000000 PRECEDING AND 600000000 FOLLOWING) AS concurrent_sessions FROM audit WHERE connection_type = 'TCP/IP'"""))

    def seq(sp, sf):
        return FE.sequences(audit(sp, sf), ["execution_time_ms", "rows_returned"]).select(
            "event_id", F.array_join(F.transform("sequence", lambda v: F.round(v[0], 3).cast("string")), "|").alias("times"),
            F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[1]).alias("total_rows"))
    cat.add("w10_sequences", lambda sp, sf: FE.sequences(audit(sp, sf), ["execution_time_ms", "rows_returned"]).select(
        "event_id", F.col("sequence")[0][0].alias("oldest_time"), F.col("sequence")[4][0].alias("newest_time"),
        F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[1]).alias("total_rows")),
        S.sql("audit", """SELECT event_id, oldest_time, execution_time_ms AS newest_time, CAST(total AS DOUBLE) AS total_rows FROM (
         SELECT *, lag(execution_time_ms, 4) OVER w AS oldest_time,
          sum(rows_returned) OVER (PARTITION BY "user" ORDER BY "timestamp", event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS total,
          row_number() OVER w AS rn FROM audit WINDOW w AS (PARTITION BY "user" ORDER BY "timestamp", event_id)) WHERE rn >= 5"""),
        rnd={"oldest_time": 4, "newest_time": 4})


def _detection(cat: Catalog) -> None:
    cat.add("d01_rule_labels", lambda sp, sf: detection(sp, sf).logs.where(
        " OR ".join(f"hit_{g}" for g in D.ROW_GROUPS)).select(
        "event_id", *[F.coalesce(f"rule_{g}", F.lit("")).alias(g.lower()) for g in D.ROW_GROUPS]),
        S.sql("det", """SELECT event_id, l_acc AS access_anomaly, l_ins AS insider_threat, l_tec AS technical_attack,
         l_des AS data_destruction, l_mul AS multi_table_access FROM det WHERE h_acc OR h_ins OR h_tec OR h_des OR h_mul"""))
    cat.add("d02_profile_exclusion", lambda sp, sf: detection(sp, sf).logs.where(f"hit_{R.PROFILE}").select("event_id", "user"),
            S.sql("det", 'SELECT event_id, "user" FROM det WHERE h_pro'))
    cat.add("d03_clean_split", lambda sp, sf: stored(sp, sf).clean.select("event_id", "user"),
            S.sql("det", 'SELECT event_id, "user" FROM det WHERE NOT (h_acc OR h_ins OR h_tec OR h_des OR h_mul OR h_pro)'))
    cat.add("d03_normal_activities", lambda sp, sf: stored(sp, sf).normal.select("event_id", "query"),
            S.sql("det", "SELECT event_id, query FROM final WHERE reason IS NULL"))
    cat.add("d04_multi_table_sessions", lambda sp, sf: detection(sp, sf).sessions.select(
        "user", "session_start", "client_ip", "start_time", "end_time", "query_count", "tables", "distinct_tables_count"),
        S.sql("sessions", """SELECT "user", session_start, client_ip, start_time, end_time, query_count, tables,
         n_tables AS distinct_tables_count FROM sessions"""),
        ts=("session_start", "start_time", "end_time"), arr=("tables",), ints=("distinct_tables_count",))
    cat.add("d04_session_evidence", lambda sp, sf: stored(sp, sf).session_evidence,
            S.sql("sessions", 'SELECT "user", session_start, "timestamp", event_id, query FROM sess_rows'),
            ts=("session_start", "timestamp"))
    viol = """viol AS (SELECT "user", sum(n) AS total_violation_count, max(critical) AS critical FROM (
        SELECT "user", CAST(h_acc AS INT) + CAST(h_ins AS INT) + CAST(h_tec AS INT) + CAST(h_des AS INT) AS n, (h_tec OR h_des) AS critical
         FROM det WHERE h_acc OR h_ins OR h_tec OR h_des
        UNION ALL SELECT "user", 1, false FROM sessions) GROUP BY "user"),
        locks AS (SELECT "user", CAST(total_violation_count AS BIGINT) AS total_violation_count,
         CASE WHEN critical THEN 'CRITICAL VIOLATION (Zero Tolerance) - Count: ' ELSE 'Threshold Exceeded - Count: ' END
          || CAST(CAST(total_violation_count AS BIGINT) AS VARCHAR) AS lock_reason FROM viol WHERE total_violation_count >= 3 OR critical)"""
    cat.add("d05_violations_and_locks", lambda sp, sf: detection(sp, sf).locks, S.sql("sessions", "SELECT * FROM locks", viol))
    cat.add("d06_safe_locks", lambda sp, sf: D.safe_locks(stored(sp, sf).locks, CFG),
            S.sql("sessions", """SELECT *, 'Automatic response: ' || lock_reason AS reason FROM locks WHERE "user" <> 'user_5'""", viol))
    cat.add("d07_final_reason", lambda sp, sf: stored(sp, sf).logs.where("is_anomaly").select(
        "event_id", "unusual_activity_reason", "behavior_group"),
        S.sql("det", "SELECT event_id, reason AS unusual_activity_reason, behavior_group FROM final WHERE reason IS NOT NULL"))

    def fallback(sp, sf):
        logs = stored(sp, sf).logs
        f = FE.static_features(logs)
        none = F.lit(None).cast("boolean")
        return f.withColumns({"is_potential_dump": none, "is_suspicious_func": none, "is_privilege_change": none}).select(
            "event_id", D.stored_anomaly_flag().alias("is_anomaly"))
    cat.add("d08_stored_anomaly_flag", fallback, S.sql("det", """SELECT event_id, (reason IS NOT NULL OR hour("timestamp") < 6
        OR regexp_matches(query, '^(INSERT|UPDATE|DELETE|CREATE USER)') OR error_code <> 0) AS is_anomaly FROM final"""))
    alerts = """al AS (SELECT *, CASE WHEN h_tec THEN 'TECHNICAL ATTACKS' WHEN h_des THEN 'DATA DESTRUCTION' WHEN h_ins THEN 'INSIDER THREATS'
         ELSE 'ACCESS ANOMALIES' END AS title, CASE WHEN h_tec THEN l_tec WHEN h_des THEN l_des WHEN h_ins THEN l_ins ELSE l_acc END AS rl
         FROM det WHERE h_tec OR h_des OR h_ins OR h_acc)"""
    body = """SELECT {keys} count(*) AS count, min("timestamp") AS first_time, max("timestamp") AS last_time,
        count(DISTINCT "user" || '@' || client_ip) AS n_targets, list_sort(list_distinct(flatten(list(string_split(rl, '; '))))) AS rules
        FROM al GROUP BY ALL"""
    cat.add("d09_alert_rollup", lambda sp, sf: detection(sp, sf).alerts.drop("desc"),
            S.sql("det", body.format(keys="title,"), alerts), ts=("first_time", "last_time"), arr=("rules",))
    cat.add("d09_alert_targets", lambda sp, sf: D.alert_targets(stored(sp, sf).logs),
            S.sql("det", """SELECT DISTINCT title, "user" || '@' || client_ip AS target FROM al""", alerts))

    def merged(sp, sf):
        rows = D.alert_rows(stored(sp, sf).logs).withColumn("batch", F.to_date("timestamp"))
        return D.merge_alerts(D.alert_rollup(rows, ("batch",)))
    cat.add("d10_merge_alerts", merged, S.sql("det", """SELECT title, count(*) AS count, min("timestamp") AS first_time,
        max("timestamp") AS last_time, list_sort(list_distinct(flatten(list(string_split(rl, '; '))))) AS rules,
        strftime(min("timestamp"), '%H:%M:%S') || ' - ' || strftime(max("timestamp"), '%H:%M:%S') AS time_range FROM al GROUP BY title""", alerts),
        ts=("first_time", "last_time"), arr=("rules",))
    cat.add("d11_alert_cooldown", lambda sp, sf: D.cooldown_alerts(stored(sp, sf).logs, CFG).drop("desc"),
            S.sql("det", body.format(keys='title, time_bucket(INTERVAL 180 SECOND, "timestamp") AS send_window,'), alerts),
            ts=("first_time", "last_time", "send_window"), arr=("rules",))
