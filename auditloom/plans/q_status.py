"""Self-monitoring: baselines, alerts, correlation, coverage and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.monitor import alerts as AL
from auditloom.monitor import baseline as B
from auditloom.monitor import coverage as C
from auditloom.monitor import integrity as I
from auditloom.monitor import library as L
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import audit
from auditloom.plans.q_monitor import INFRA, chain_sql, in_list, infra, q
from auditloom.sources.files import trail_entries

SPLIT = "2024-01-16 00:00:00"
NOW = "2024-01-20 12:00:00"
CFG = B.BaselineConfig(concurrency_span_us=1_800_000_000, session_limit=1)
KEY = "example key"


def t(s):
    return F.lit(s).cast("timestamp")


# --- baselines -------------------------------------------------------------------------------------------------------
def marked(sp, sf):
    """Events with their concurrency; commands and hosts of the second half partly new."""
    return B.with_concurrency(infra(sp, sf), CFG)


def base(sp, sf, upto=SPLIT):
    return marked(sp, sf).where(F.col("timestamp") < t(upto))


BASE = f"""ev2 AS (SELECT *, greatest(coalesce(sum(CASE WHEN event_type IN ('database_connection', 'db_connect') THEN 1 ELSE 0 END) OVER (PARTITION BY user_account ORDER BY epoch_us("timestamp")
   RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING), 0), 1) AS concurrent FROM infra),
 hist AS (SELECT * FROM ev2 WHERE "timestamp" < TIMESTAMP '{{upto}}'),
 mem AS (SELECT user_account, kind, value, count(*) AS cnt FROM (SELECT user_account, 'host' AS kind, source_ip AS value FROM hist UNION ALL SELECT user_account, 'database', "database" FROM hist
   UNION ALL SELECT user_account, 'command', command FROM hist UNION ALL SELECT user_account, 'hour', CAST(hour("timestamp") AS VARCHAR) FROM hist
   UNION ALL SELECT user_account, 'day', CAST(isodow("timestamp") - 1 AS VARCHAR) FROM hist) WHERE value <> '' GROUP BY ALL),
 b0 AS (SELECT user_account, count(*) AS events, min("timestamp") AS profile_start, max("timestamp") AS last_seen, coalesce(avg(CASE WHEN duration > 0 THEN duration END), 0) AS avg_duration,
   stddev_samp(CASE WHEN duration > 0 THEN duration END) AS sd, max(concurrent) AS max_concurrent FROM hist GROUP BY 1),
 b1 AS (SELECT user_account, count_if(kind = 'host') AS n_hosts, count_if(kind = 'database') AS n_databases, count_if(kind = 'command') AS n_commands,
   list_sort(list(TRY_CAST(value AS INTEGER)) FILTER (kind = 'hour')) AS active_hours, list_sort(list(TRY_CAST(value AS INTEGER)) FILTER (kind = 'day')) AS active_days FROM mem GROUP BY 1),
 bl AS (SELECT b0.*, n_hosts, n_databases, n_commands, active_hours, active_days, events / ((epoch_us(last_seen) - epoch_us(profile_start)) / 3.6e9::DOUBLE) AS per_hour,
   avg_duration + 2.5 * sd AS duration_limit, greatest(max_concurrent, 1) AS concurrent_limit FROM b0 JOIN b1 ON b1.user_account = b0.user_account),
 bm AS (SELECT *, a >= 24 AND n_hosts > 0 AND len(active_hours) >= 2 AND n_commands >= 1 AND events >= 100 AS established,
   a >= 24 AND n_hosts > 0 AND len(active_hours) >= 2 AND n_commands >= 1 AND events >= 100 AND a >= 72 AS mature FROM (
   SELECT *, (epoch_us(TIMESTAMP '{{now}}') - epoch_us(profile_start)) / 3.6e9::DOUBLE AS a FROM bl))"""


def checked(sp, sf):
    """Later events with some commands and hosts the history does not know."""
    late = marked(sp, sf).where(F.col("timestamp") >= t(SPLIT))
    return late.withColumns({
        "source_ip": F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("172.16.0."), (F.col("event_id") % 5).cast("string"))).otherwise(F.col("source_ip")),
        "action_details": F.when(F.col("event_id") % 30 == 0, F.map_concat(F.map_filter("action_details", lambda k, v: k != "command"),
                                                                         F.create_map(F.lit("command"), F.lit("Shutdown")))).otherwise(F.col("action_details"))})


CHECKED = f"""late AS (SELECT event_id, "timestamp", user_account, concurrent, CASE WHEN event_id % 40 = 0 THEN '172.16.0.' || CAST(event_id % 5 AS VARCHAR) ELSE source_ip END AS source_ip,
 CASE WHEN event_id % 30 = 0 THEN 'Shutdown' ELSE command END AS command FROM ev2 WHERE "timestamp" >= TIMESTAMP '{SPLIT}')"""


def _base_sql(upto=SPLIT, now=NOW):
    return BASE.replace("{upto}", upto).replace("{now}", now)


def mature(sp, sf):
    hist = base(sp, sf)
    return B.mature_anomalies(checked(sp, sf), B.with_maturity(B.baselines(hist, CFG), t(NOW), CFG), B.members(hist), CFG)


MATURE = """anom AS (SELECT l.event_id, l."timestamp", l.user_account, x.* FROM late l JOIN bm ON bm.user_account = l.user_account AND bm.mature, LATERAL (
 SELECT 'new_host_connection' AS anomaly_type, 'medium' AS severity, 0.6::DOUBLE AS confidence, 1.0::DOUBLE AS deviation, source_ip AS observed WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.user_account = l.user_account AND kind = 'host' AND value = source_ip)
 UNION ALL SELECT 'unusual_time_access', 'low', 0.4, 0.8, CAST(hour(l."timestamp") AS VARCHAR) || '/' || CAST(isodow(l."timestamp") - 1 AS VARCHAR) WHERE NOT list_contains(active_hours, hour(l."timestamp")) OR NOT list_contains(active_days, isodow(l."timestamp") - 1)
 UNION ALL SELECT 'excessive_concurrent_sessions', 'high', 0.8, concurrent / CAST(concurrent_limit AS DOUBLE), CAST(CAST(concurrent AS BIGINT) AS VARCHAR) WHERE concurrent > concurrent_limit
 UNION ALL SELECT 'unusual_command', 'medium', 0.6, 1.0, command WHERE command <> '' AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.user_account = l.user_account AND kind = 'command' AND value = command)) x)"""


def register(cat: Catalog) -> None:
    _baselines(cat)
    _alerts(cat)
    _coverage(cat)
    _integrity(cat)


def _baselines(cat: Catalog) -> None:
    cols = ("user_account", "events", "profile_start", "avg_duration", "max_concurrent", "n_hosts", "n_databases", "n_commands", "active_hours", "active_days", "per_hour")
    cat.add("b01_baselines", lambda sp, sf: B.baselines(base(sp, sf), CFG).select(*cols),
            S.sql("audit", f"SELECT {', '.join(cols)} FROM bl", INFRA, _base_sql()), ts=("profile_start",), arr=("active_hours", "active_days"), big=("max_concurrent", "n_hosts", "n_databases", "n_commands"),
            rnd={"avg_duration": 4, "per_hour": 4})
    cat.add("b01_members", lambda sp, sf: B.members(base(sp, sf)), S.sql("audit", "SELECT * FROM mem", INFRA, _base_sql()))
    cat.add("b01_command_frequencies", lambda sp, sf: B.command_frequencies(B.members(base(sp, sf))),
            S.sql("audit", "SELECT user_account, value AS command, cnt / CAST(sum(cnt) OVER (PARTITION BY user_account) AS DOUBLE) AS frequency FROM mem WHERE kind = 'command'", INFRA, _base_sql()), rnd={"frequency": 6})
    cat.add("b02_limits", lambda sp, sf: B.baselines(base(sp, sf), CFG).select("user_account", "frequency_limit", "duration_limit", "concurrent_limit"),
            S.sql("audit", "SELECT user_account, per_hour * 4 AS frequency_limit, duration_limit, concurrent_limit FROM bl", INFRA, _base_sql()), big=("concurrent_limit",), rnd={"frequency_limit": 4, "duration_limit": 4})
    early = "2024-01-02 06:00:00"
    cat.add("b03_maturity", lambda sp, sf: B.with_maturity(B.baselines(base(sp, sf, early), CFG), t("2024-01-04 00:00:00"), B.BaselineConfig(min_events=53)).select("user_account", "events", "established", "mature"),
            S.sql("audit", "SELECT user_account, events, a >= 24 AND events >= 53 AS established, a >= 72 AND events >= 53 AS mature FROM bm", INFRA, _base_sql(early, "2024-01-04 00:00:00")))

    def learning(sp, sf):
        hist = base(sp, sf)
        b = B.with_maturity(B.baselines(hist, CFG), t(NOW), B.BaselineConfig(learning_hours=10_000))
        return B.learning_anomalies(checked(sp, sf), b, B.members(hist))
    cat.add("b04_learning_anomalies", learning, S.sql("audit", """SELECT event_id, "timestamp", user_account, 'excessive_concurrent_sessions' AS anomaly_type, 'high' AS severity, 0.9::DOUBLE AS confidence,
         concurrent / CAST(concurrent_limit AS DOUBLE) AS deviation, CAST(CAST(concurrent AS BIGINT) AS VARCHAR) AS observed FROM late JOIN bm USING (user_account) WHERE established AND concurrent > greatest(concurrent_limit, 5)
        UNION ALL SELECT event_id, "timestamp", l.user_account, 'new_subnet_connection', 'high', 0.8, 1.0, l.source_ip FROM late l JOIN bm ON bm.user_account = l.user_account AND established AND n_hosts >= 2
         WHERE array_to_string(string_split(source_ip, '.')[1:3], '.') NOT IN (SELECT array_to_string(string_split(value, '.')[1:3], '.') FROM mem m WHERE m.user_account = l.user_account AND kind = 'host')""",
        INFRA, _base_sql(), CHECKED), ts=("timestamp",), rnd={"deviation": 6, "confidence": 6}, )
    cat.add("b05_mature_anomalies", mature, S.sql("audit", "SELECT * FROM anom", INFRA, _base_sql(), CHECKED, MATURE), ts=("timestamp",), rnd={"deviation": 6, "confidence": 6})
    cat.add("b06_anomaly_threats", lambda sp, sf: B.anomaly_threats(mature(sp, sf)).select(
        "detection_id", "timestamp", "threat_type", "severity", "confidence_score", F.col("attack_indicators")["observed_value"].alias("observed")),
        S.sql("audit", """SELECT CAST(event_id AS VARCHAR) || ':' || anomaly_type AS detection_id, "timestamp", 'behavioral_anomaly_' || anomaly_type AS threat_type, severity, confidence AS confidence_score, observed FROM anom""",
              INFRA, _base_sql(), CHECKED, MATURE), ts=("timestamp",), rnd={"confidence_score": 6})
    cat.add("b06_recent_anomalies", lambda sp, sf: B.recent_anomalies(mature(sp, sf), t(NOW), 24, "user_3").select("event_id", "anomaly_type"),
            S.sql("audit", f"""SELECT event_id, anomaly_type FROM anom WHERE user_account = 'user_3' AND "timestamp" >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR""", INFRA, _base_sql(), CHECKED, MATURE))
    act = """ag AS (SELECT *, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY user_account, source_ip ORDER BY "timestamp", event_id))) / 1e6 AS g FROM infra),
      hc AS (SELECT user_account, source_ip, hour("timestamp") AS h, count(*) AS c FROM infra GROUP BY 1, 2, 3),
      th AS (SELECT user_account, source_ip, array_to_string(list(h ORDER BY c DESC, h)[1:3], ',') AS top_hours, max(c) AS busiest FROM hc GROUP BY 1, 2)"""
    cat.add("v10_activity_baseline", lambda sp, sf: B.activity_baseline(infra(sp, sf)).select(
        "user_account", "source_ip", "event_count", "avg_gap", "std_gap", "avg_length", "std_length", F.coalesce(F.col("query_types")["select"], F.lit(0)).alias("n_select"),
        F.array_max(F.map_values("hour_counts")).alias("busiest"), "top_hours"),
        S.sql("audit", """SELECT a.user_account, a.source_ip, count(*) AS event_count, coalesce(avg(g), 0) AS avg_gap, coalesce(stddev_samp(g), 0) AS std_gap, avg(length(query)) AS avg_length, stddev_samp(length(query)) AS std_length,
         count_if(contains(lower(query), 'select'))::BIGINT AS n_select, any_value(busiest) AS busiest, any_value(top_hours) AS top_hours FROM ag a JOIN th ON th.user_account = a.user_account AND th.source_ip = a.source_ip
         GROUP BY 1, 2 HAVING count(*) >= 10""", INFRA, act), rnd={"avg_gap": 3, "std_gap": 3, "avg_length": 4, "std_length": 4})
    cat.add("v11_recent_times", lambda sp, sf: B.keep_recent_times(infra(sp, sf)).select("event_id", "user_account"),
            S.sql("audit", """SELECT event_id, user_account FROM (SELECT *, max("timestamp") OVER (PARTITION BY user_account, source_ip) AS m FROM infra) WHERE "timestamp" >= m - INTERVAL 24 HOUR""", INFRA))
    cat.add("v11_newest_volumes", lambda sp, sf: B.keep_newest(infra(sp, sf), most=100, keep=50).select("event_id", "user_account", "source_ip"),
            S.sql("audit", """SELECT event_id, user_account, source_ip FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_account, source_ip ORDER BY "timestamp" DESC, event_id DESC) AS r
             FROM infra WINDOW w AS (PARTITION BY user_account, source_ip)) WHERE n <= 100 OR r <= 50""", INFRA))
    from auditloom.monitor.patterns import statement_patterns
    cat.add("v11_statement_patterns", lambda sp, sf: statement_patterns(infra(sp, sf)).groupBy("user_account", "source_ip").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("statements")),
            S.sql("audit", """SELECT user_account, source_ip, count(DISTINCT n) AS patterns, count(*) AS statements FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(query), '''[^'']*''', '''STRING''', 'g'),
              '\\b\\d+\\b', 'NUMBER', 'g'), '/\\*.*?\\*/', '', 'g'), '(?m)--.*$', '', 'g')) AS n FROM infra) GROUP BY 1, 2""", INFRA))


# --- alerts ----------------------------------------------------------------------------------------------------------
def threats(sp, sf):
    """One threat per event."""
    comp = F.expr(f"element_at(array({', '.join(q(c) for c in L.COMPONENTS)}), CAST(k % 5 + 1 AS INT))")
    other = F.expr(f"element_at(array({', '.join(q(c) for c in L.COMPONENTS)}), CAST(event_id % 5 + 1 AS INT))")
    return audit(sp, sf).select(
        F.concat(F.lit("det"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("detection_id"), "event_id", "timestamp",
        F.concat(F.lit("type_"), (F.col("k") % 4).cast("string")).alias("threat_type"),
        F.expr("element_at(array('low', 'medium', 'high', 'critical'), CAST(k % 4 + 1 AS INT))").alias("severity"),
        F.array_distinct(F.array(comp, other)).alias("affected_components"),
        F.create_map(F.lit("kind"), (F.col("k") % 5).cast("string"), F.lit("user"), F.col("user")).alias("attack_indicators"),
        (F.col("k") / F.lit(100.0)).alias("confidence_score"), F.array(F.lit("investigate"), F.lit("block")).alias("response_actions"), "k", "user")


_COMP = "([" + ", ".join(q(c) for c in L.COMPONENTS) + "])"
THREATS = f"""thr AS (SELECT 'det' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS detection_id, event_id, "timestamp", 'type_' || CAST(k % 4 AS VARCHAR) AS threat_type, (['low', 'medium', 'high', 'critical'])[k % 4 + 1] AS severity,
 {_COMP}[k % 5 + 1] AS c1, {_COMP}[event_id % 5 + 1] AS c2, CASE WHEN k % 5 = event_id % 5 THEN [{_COMP}[k % 5 + 1]] ELSE [{_COMP}[k % 5 + 1], {_COMP}[event_id % 5 + 1]] END AS comps, k / 100.0::DOUBLE AS confidence_score,
 k % 4 + 1 AS priority, "user", k FROM audit)"""


def alerts(sp, sf):
    return AL.alerts_from_threats(threats(sp, sf).drop("k", "user"))


def rules(sp, sf):
    """Notification rules derived from the regions."""
    return X.read_table(sp, sf, "region").selectExpr(
        "concat('rule_', r_regionkey) AS rule_id", "r_regionkey <> 4 AS enabled", "CAST(r_regionkey % 4 + 1 AS INT) AS min_priority",
        "CASE WHEN r_regionkey % 2 = 1 THEN array('audit_log', 'database') END AS components", "CASE WHEN r_regionkey = 2 THEN array('type_2', 'type_3') END AS tags")


def _alerts(cat: Catalog) -> None:
    aid = """'alert_' || strftime("timestamp", '%Y%m%d_%H%M%S') || '_' || substr(detection_id, 1, 8)"""
    cat.add("l01_alerts", lambda sp, sf: alerts(sp, sf).select("alert_id", "priority", "title", "description", "tags"),
            S.sql("audit", f"""SELECT {aid} AS alert_id, priority, threat_type || ' detected on ' || array_to_string(comps, ', ') AS title,
             'Threat confidence: ' || printf('%.2f', confidence_score) || '. Attack indicators: kind, user. Recommended actions: investigate, block' AS description, list_concat([threat_type, severity], comps) AS tags FROM thr""", THREATS), arr=("tags",))
    cat.add("l02_suppression", lambda sp, sf: AL.suppress(threats(sp, sf), 43_200).select("event_id", "threat_type"),
            chain_sql("audit", [THREATS, """al AS (SELECT *, threat_type || '|' || array_to_string(list_sort(comps), '|') AS key FROM thr)"""], "event_id, threat_type", 43_200_000_000))
    cat.add("l03_active_alerts", lambda sp, sf: AL.filter_alerts(alerts(sp, sf), "high", "new", ["audit_log"], ["type_2", "database"]).select("alert_id", "title"),
            S.sql("audit", f"""SELECT {aid} AS alert_id, threat_type || ' detected on ' || array_to_string(comps, ', ') AS title FROM thr WHERE priority = 3 AND list_contains(comps, 'audit_log')
             AND (threat_type = 'type_2' OR list_contains(comps, 'database'))""", THREATS))
    cat.add("l03_alerts_by_priority", lambda sp, sf: AL.count_by_priority(alerts(sp, sf)), S.sql("audit", "SELECT priority, count(*) AS n FROM thr GROUP BY 1", THREATS))
    cat.add("l04_notification_rules", lambda sp, sf: AL.matching_rules(alerts(sp, sf), rules(sp, sf)).select("alert_id", "rule_id"),
            S.sql("audit", f"""SELECT {aid} AS alert_id, 'rule_' || CAST(r_regionkey AS VARCHAR) AS rule_id FROM thr JOIN region ON r_regionkey <> 4 AND priority >= r_regionkey % 4 + 1
             AND (r_regionkey % 2 = 0 OR list_has_any(comps, ['audit_log', 'database'])) AND (r_regionkey <> 2 OR threat_type IN ('type_2', 'type_3'))""", THREATS))

    def open_alerts(sp, sf):
        return alerts(sp, sf).withColumns({"escalation_count": F.when(F.second("timestamp") % 2 == 0, 0).otherwise(F.second("timestamp") % 5),
                                           "last_escalation": F.when(F.minute("timestamp") % 3 == 0, t(NOW) - F.expr("INTERVAL 10 MINUTES")).when(F.minute("timestamp") % 3 == 1, F.col("timestamp"))})
    cat.add("l05_escalations_due", lambda sp, sf: AL.escalations_due(open_alerts(sp, sf), t(NOW)).select("alert_id", "priority", "escalation_count"),
            S.sql("audit", f"""SELECT {aid} AS alert_id, priority, ec AS escalation_count FROM (SELECT *, CAST(CASE WHEN second("timestamp") % 2 = 0 THEN 0 ELSE second("timestamp") % 5 END AS INTEGER) AS ec FROM thr)
             WHERE "timestamp" <= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AND ec < 3 AND minute("timestamp") % 3 <> 0 AND priority >= 3""", THREATS))


# --- coverage --------------------------------------------------------------------------------------------------------
def checks(sp, sf):
    return audit(sp, sf).select(F.concat(F.lit("c"), (F.col("event_id") % 6).cast("string")).alias("component"), "timestamp", F.col("event_id").alias("check_id"),
                                (F.col("k") % 3 != 0).alias("is_healthy"), (F.col("value") * 20).alias("response_time_ms"))


def health(sp, sf):
    return audit(sp, sf).groupBy(F.concat(F.lit("c"), (F.col("event_id") % 12).cast("string")).alias("component")).agg(
        F.max_by(F.col("k") % 4 != 0, "event_id").alias("healthy"), F.when(F.min(F.col("event_id") % 12) < 7, "monitor").otherwise("detector").alias("kind"))


HEALTH = """health AS (SELECT 'c' || CAST(event_id % 12 AS VARCHAR) AS component, arg_max(k % 4 <> 0, event_id) AS healthy, CASE WHEN min(event_id % 12) < 7 THEN 'monitor' ELSE 'detector' END AS kind FROM audit GROUP BY 1)"""


def all_interactions(sp, sf):
    return infra(sp, sf).select(F.lit("database").alias("source"), F.col("target_component").alias("target"), F.col("event_type").alias("type"), "timestamp")


def interactions(sp, sf):
    """What a watcher of some components sees: two components and one kind are missing, which is what blind spots tell."""
    return all_interactions(sp, sf).where("type <> 'query_executed' AND target not in ('monitoring_service', 'performance_schema')")


def runs(sp, sf):
    """Analyses of three servers."""
    return audit(sp, sf).select(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("server"), "timestamp", "event_id")


_CORR = """corr AS (SELECT bucket, n_events, components, least(1.0::DOUBLE, n_events / 10.0::DOUBLE) AS correlation_score FROM (SELECT time_bucket(INTERVAL 5 MINUTE, "timestamp") AS bucket, count(*) AS n_events,
 list_sort(list(DISTINCT target_component)) AS components FROM infra GROUP BY 1 HAVING count(*) > 1))"""
COVERAGE = f"""spine AS (SELECT unnest({_COMP}) AS component),
cov AS (SELECT component, coalesce(n, 0) AS activity, CASE WHEN n > 50 THEN 1.0::DOUBLE WHEN n > 20 THEN 0.8::DOUBLE WHEN n > 5 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS coverage,
 CASE WHEN n > 50 THEN 'full' WHEN n > 20 THEN 'partial' WHEN n > 5 THEN 'minimal' ELSE 'none' END AS status FROM spine LEFT JOIN (SELECT target_component, count(*) AS n FROM infra
 WHERE "timestamp" > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND "timestamp" <= TIMESTAMP '{NOW}' GROUP BY 1) x ON x.target_component = component),
inter AS (SELECT 'database' AS source, target_component AS target, event_type AS type, "timestamp" FROM infra WHERE event_type <> 'query_executed' AND target_component NOT IN ('monitoring_service', 'performance_schema')),
gp AS (SELECT *, least(100.0::DOUBLE, gap_sec / 3600 * 100) AS gap_percentage FROM (SELECT 's' || CAST(event_id % 3 AS VARCHAR) AS server, "timestamp", (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY event_id % 3 ORDER BY "timestamp"))) / 1e6::DOUBLE AS gap_sec
 FROM audit) WHERE gap_sec > 600)"""


def cov(sp, sf):
    return C.coverage(infra(sp, sf), t(NOW), 6)


def _coverage(cat: Catalog) -> None:
    cat.add("c01_correlations", lambda sp, sf: C.correlations(infra(sp, sf)),
            S.sql("audit", """SELECT bucket, n_events, components, correlation_score, 'corr_' || strftime(bucket, '%Y%m%d_%H%M') AS correlation_id, CASE WHEN correlation_score > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_assessment FROM corr""", INFRA, _CORR),
            ts=("bucket",), arr=("components",), rnd={"correlation_score": 6})
    cat.add("c02_overall_status", lambda sp, sf: C.overall_status(threats(sp, sf), health(sp, sf), infra(sp, sf), t(NOW)),
            S.sql("audit", f"""SELECT (SELECT count(*) FROM thr) AS active_threats, (SELECT count(*) FROM health) AS monitored_components, (SELECT count_if(healthy) FROM health)::BIGINT AS healthy_components,
             (SELECT count(*) FROM infra WHERE "timestamp" > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND "timestamp" <= TIMESTAMP '{NOW}') AS recent_events, 'critical' AS overall_threat_level""", INFRA, THREATS, HEALTH))
    cat.add("c03_forensic_events", lambda sp, sf: C.forensic_events(infra(sp, sf), t("2024-01-10"), t("2024-01-12"), ("audit_log", "database")).select("event_id", "in_timeline", "is_evidence", "summary"),
            S.sql("audit", """SELECT event_id, risk_score > 0.5 AS in_timeline, risk_score > 0.7 AS is_evidence, event_type || ' on ' || target_component AS summary FROM infra
             WHERE "timestamp" BETWEEN '2024-01-10' AND '2024-01-12' AND target_component IN ('audit_log', 'database')""", INFRA))
    cat.add("c04_threats_by_severity", lambda sp, sf: C.threats_by_severity(threats(sp, sf)), S.sql("audit", "SELECT severity, count(*) AS n FROM thr GROUP BY 1", THREATS))
    cat.add("c04_threats_by_component", lambda sp, sf: C.threats_by_component(threats(sp, sf)), S.sql("audit", "SELECT component, count(*) AS n FROM (SELECT unnest(comps) AS component FROM thr) GROUP BY 1", THREATS))
    cat.add("c04_recent_threats", lambda sp, sf: C.recent_threats(threats(sp, sf), t(NOW)).select("detection_id", "threat_type", "severity"),
            S.sql("audit", f"""SELECT detection_id, threat_type, severity FROM thr WHERE "timestamp" > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR""", THREATS))
    cat.add("c05_events_by_component", lambda sp, sf: C.events_by_component(infra(sp, sf)),
            S.sql("audit", "SELECT target_component, count(*) AS n, count_if(risk_score > 0.7)::BIGINT AS high_risk FROM infra GROUP BY 1", INFRA))
    cat.add("c05_threat_timeline", lambda sp, sf: C.threat_timeline(infra(sp, sf), C.correlations(infra(sp, sf))),
            S.sql("audit", """SELECT "timestamp", 'high_risk_event' AS type, event_type || ' on ' || target_component AS description, risk_score AS score FROM infra WHERE risk_score > 0.7
             UNION ALL SELECT bucket, 'correlation', 'Correlated activity across ' || CAST(len(components) AS VARCHAR) || ' components', correlation_score FROM corr""", INFRA, _CORR), ts=("timestamp",), rnd={"score": 6})

    def status(sp, sf):
        e = infra(sp, sf)
        return C.recommendations(C.side_by_side(
            C.system_health(health(sp, sf), e).select("overall_status"), C.overall_coverage(cov(sp, sf)).select(F.col("overall_coverage").alias("average_coverage")),
            C.blind_spots(cov(sp, sf), interactions(sp, sf), C.analysis_gaps(runs(sp, sf))).agg(F.count(F.lit(1)).alias("blind_spots")),
            threats(sp, sf).agg(F.count(F.lit(1)).alias("active_alerts")), e.agg(F.count_if(F.col("risk_score") > 0.7).alias("high_risk_events"))))
    blind = """bs AS (SELECT 'component' AS kind, component AS subject, CASE WHEN coverage < 0.3 THEN 'High' ELSE 'Medium' END AS risk_level, round((1.0 - coverage) * 100, 9) AS gap_percentage FROM cov WHERE coverage < 0.8
      UNION ALL SELECT 'interaction', s || '_' || t, 'Medium', 100.0 FROM (VALUES ('database', 'user_account'), ('user_account', 'performance_schema'), ('monitoring_service', 'audit_log')) e(s, t)
       WHERE NOT EXISTS (SELECT 1 FROM inter WHERE source = s AND target = t)
      UNION ALL SELECT 'behavioral', component, 'Low', 50.0 FROM cov WHERE activity > 0 AND component NOT IN (SELECT source FROM inter UNION SELECT target FROM inter)
      UNION ALL SELECT 'temporal', strftime("timestamp", '%Y-%m-%d %H:%M:%S'), 'Medium', gap_percentage FROM gp),
     hs AS (SELECT avg(CAST(healthy AS INTEGER)) FILTER (kind = 'monitor') AS monitor_ratio, avg(CAST(healthy AS INTEGER)) FILTER (kind = 'detector') AS detector_ratio FROM health),
     h2 AS (SELECT *, CASE WHEN monitor_ratio >= 0.8 AND detector_ratio >= 0.8 THEN 'healthy' WHEN monitor_ratio >= 0.5 AND detector_ratio >= 0.5 THEN 'warning' WHEN monitor_ratio > 0 OR detector_ratio > 0 THEN 'critical' ELSE 'offline' END AS overall_status FROM hs)"""
    cat.add("c06_recommendations", lambda sp, sf: status(sp, sf).select("overall_status", "average_coverage", "blind_spots", "recommendations"),
            S.sql("audit", """SELECT overall_status, average_coverage, blind_spots, concat_ws(',', CASE WHEN overall_status <> 'healthy' THEN 'Investigate and resolve unhealthy monitoring components' END,
              CASE WHEN average_coverage < 0.8 THEN 'Improve monitoring coverage - current average below 80%' END, CASE WHEN blind_spots > 5 THEN 'Address ' || CAST(blind_spots AS VARCHAR) || ' identified monitoring blind spots' END,
              CASE WHEN (SELECT count(*) FROM thr) > 10 THEN 'High number of active alerts - review alert rules and thresholds' END,
              CASE WHEN (SELECT count_if(risk_score > 0.7) FROM infra) > 20 THEN 'High number of risk events detected - investigate potential security incidents' END) AS recommendations
             FROM (SELECT overall_status, (SELECT round(avg(coverage), 9) FROM cov) AS average_coverage, (SELECT count(*) FROM bs) AS blind_spots FROM h2)""", INFRA, THREATS, HEALTH, COVERAGE, blind), rnd={"average_coverage": 6})
    cat.add("c07_emergency_level", lambda sp, sf: C.emergency_level(threats(sp, sf).withColumn("hour", F.date_trunc("hour", "timestamp")), ["hour"]),
            S.sql("audit", """SELECT *, CASE WHEN critical_count >= 2 OR total_score >= 0.95 THEN 'lockdown' WHEN critical_count > 0 OR total_score >= 0.9 THEN 'critical' WHEN high_count >= 2 OR total_score >= 0.7 THEN 'high'
              WHEN high_count > 0 OR total_score >= 0.4 THEN 'elevated' ELSE 'none' END AS level FROM (SELECT date_trunc('hour', "timestamp") AS hour, round(sum((([0.1, 0.4, 0.7, 1.0])[k % 4 + 1])::DOUBLE), 9) AS total_score,
              count_if(severity = 'critical')::BIGINT AS critical_count, count_if(severity = 'high')::BIGINT AS high_count FROM thr GROUP BY 1)""", THREATS), ts=("hour",), rnd={"total_score": 6})
    cat.add("c08_persistent_threats", lambda sp, sf: C.persistent_threats(threats(sp, sf)).drop("signature"),
            S.sql("audit", """SELECT threat_type, min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(*) AS occurrences, round(least(1.0::DOUBLE, count(*) * 0.2::DOUBLE), 9) AS persistence_score
             FROM thr GROUP BY threat_type, k % 5, "user" """, THREATS), ts=("first_seen", "last_seen"), rnd={"persistence_score": 6})

    def compromise(sp, sf):
        ind = F.map_filter(F.create_map(F.lit("admin_access_attempts"), (F.col("k") % 5).cast("string"), F.lit("credential_indicators"), F.when(F.col("k") % 2 == 0, "x"),
                                        F.lit("system_file_modifications"), F.when(F.col("k") % 3 == 0, "x"), F.lit("network_anomalies"), F.when(F.col("k") % 7 == 0, "x")), lambda k, v: v.isNotNull())
        return audit(sp, sf).select("event_id", C.compromise_score(ind).alias("score"))
    cat.add("c08_compromise_score", compromise, S.sql("audit", """SELECT event_id, round(least(1.0, least(0.3::DOUBLE, (k % 5) * 0.1::DOUBLE) + CASE WHEN k % 2 = 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END
         + CASE WHEN k % 7 = 0 THEN 0.2::DOUBLE ELSE 0 END), 9) AS score FROM audit"""), rnd={"score": 6})
    cat.add("c09_coverage", cov, S.sql("audit", "SELECT component, activity, coverage, status FROM cov", INFRA, COVERAGE), rnd={"coverage": 6})
    cat.add("c09_overall_coverage", lambda sp, sf: C.overall_coverage(cov(sp, sf)), S.sql("audit", "SELECT round(avg(coverage), 9) AS overall_coverage FROM cov", INFRA, COVERAGE), rnd={"overall_coverage": 6})
    cat.add("c10_blind_spots", lambda sp, sf: C.blind_spots(cov(sp, sf), interactions(sp, sf), C.analysis_gaps(runs(sp, sf))),
            S.sql("audit", "SELECT * FROM bs", INFRA, THREATS, HEALTH, COVERAGE, blind), rnd={"gap_percentage": 4})
    cat.add("c11_interaction_patterns", lambda sp, sf: C.interaction_patterns(all_interactions(sp, sf)),
            S.sql("audit", "SELECT source, target, type, count(*) / 3600.0::DOUBLE AS frequency, list_sort(list(DISTINCT strftime(\"timestamp\", '%H'))) AS hours FROM (SELECT 'database' AS source, target_component AS target, event_type AS type, \"timestamp\" FROM infra) GROUP BY 1, 2, 3", INFRA), arr=("hours",), rnd={"frequency": 6})
    cat.add("c12_system_health", lambda sp, sf: C.system_health(health(sp, sf), infra(sp, sf)),
            S.sql("audit", 'SELECT monitor_ratio, detector_ratio, overall_status, (SELECT max("timestamp") FROM infra) AS last_event_time FROM h2', INFRA, THREATS, HEALTH, COVERAGE, blind),
            ts=("last_event_time",), rnd={"monitor_ratio": 6, "detector_ratio": 6})
    cat.add("w06_analysis_gaps", lambda sp, sf: C.analysis_gaps(runs(sp, sf)), S.sql("audit", 'SELECT server, "timestamp", gap_sec, gap_percentage FROM gp', INFRA, COVERAGE), ts=("timestamp",), rnd={"gap_sec": 2, "gap_percentage": 2})
    cat.add("w08_rate_degradation", lambda sp, sf: C.rate_degradation(audit(sp, sf), ["user", "client_ip"], "event_id", "execution_time_ms"),
            S.sql("audit", """SELECT "user", client_ip, avg(v) FILTER (r <= 10) AS avg_recent, avg(v) FILTER (r > 10) AS avg_older, coalesce(count(*) >= 20 AND avg(v) FILTER (r > 10) > 0 AND avg(v) FILTER (r <= 10) / avg(v) FILTER (r > 10) < 0.8, false) AS degraded
             FROM (SELECT "user", client_ip, execution_time_ms AS v, row_number() OVER (PARTITION BY "user", client_ip ORDER BY event_id DESC) AS r FROM audit) WHERE r <= 20 GROUP BY 1, 2"""), rnd={"avg_recent": 3, "avg_older": 3})
    cat.add("w09_health_checks", lambda sp, sf: C.health_checks(checks(sp, sf)),
            S.sql("audit", """SELECT component, "timestamp", check_id, healthy_count, avg_response_ms, CASE WHEN healthy_count <= 1 THEN 'HIGH' END AS compromise, CASE WHEN avg_response_ms > 5000 THEN 'MEDIUM' END AS degradation FROM (
             SELECT *, sum(h) OVER w AS healthy_count, avg(ms) OVER w AS avg_response_ms, count(*) OVER w AS n FROM (SELECT 'c' || CAST(event_id % 6 AS VARCHAR) AS component, "timestamp", event_id AS check_id, CAST(k % 3 <> 0 AS INTEGER) AS h, value * 20 AS ms FROM audit)
             WINDOW w AS (PARTITION BY component ORDER BY "timestamp", check_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5"""), ts=("timestamp",), ints=("healthy_count",), rnd={"avg_response_ms": 3})


# --- integrity -------------------------------------------------------------------------------------------------------
FIELDS = ("entry_id", "event_type", "source_ip", "user_account")


def entries(sp, sf):
    return infra(sp, sf).select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry_id"), "event_type", "source_ip", "user_account")


def _hmac_sql(msg: str, key: str) -> str:
    k = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({msg}))))"


def _integrity(cat: Catalog) -> None:
    js = """'{"entry_id":"e' || CAST(event_id AS VARCHAR) || '","event_type":"' || event_type || '","source_ip":"' || source_ip || '","user_account":"' || user_account || '"}'"""
    cat.add("i01_record_hmac", lambda sp, sf: I.sign(entries(sp, sf), FIELDS, KEY).select("event_id", "integrity_hash"),
            S.sql("audit", f"SELECT event_id, {_hmac_sql(js, KEY)} AS integrity_hash FROM infra", INFRA))

    def tampered(sp, sf):
        """Signed lines of which some were altered, lost their hash, were broken, or are headers."""
        n, v = F.col("event_id"), F.col("value")
        line = (F.when(n % 37 == 0, F.replace(v, F.lit("user_"), F.lit("root_"))).when(n % 41 == 0, F.regexp_replace(v, r'"integrity_hash":"[0-9a-f]+",', ""))
                .when(n % 43 == 0, F.concat(F.lit("{{"), v)).when(n % 47 == 0, F.lit('{"log_type": "audit", "version": "1.0.0"}')).otherwise(v))
        return I.signed_lines(entries(sp, sf), FIELDS, KEY).select(n.alias("line"), line.alias("value"))
    cat.add("i02_trail_verification", lambda sp, sf: I.verify_trail(tampered(sp, sf), FIELDS, KEY),
            S.sql("audit", """SELECT event_id AS line, CASE WHEN event_id % 37 = 0 THEN 'Integrity verification failed at line ' WHEN event_id % 41 = 0 THEN 'Missing integrity hash at line ' ELSE 'Corrupted entry at line ' END
             || CAST(event_id AS VARCHAR) AS error FROM infra WHERE event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0""", INFRA))

    def sums(sp, sf):
        d = X.read_table(sp, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("config/")).when(F.col("doc_id") % 4 == 1, F.lit("audit_log/")).otherwise(F.lit("data/")),
                                                                        F.col("doc_id").cast("string")).alias("path"), "text")
        before = d.where("doc_id % 13 <> 0").select("path", F.sha2("text", 256).alias("checksum"))
        now = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("checksum"))
        return I.compare_checksums(before, now)
    dirs = "CASE doc_id % 4 WHEN 0 THEN 'config/' WHEN 1 THEN 'audit_log/' ELSE 'data/' END || CAST(doc_id AS VARCHAR)"
    chg = f"""chg AS (SELECT * FROM (SELECT {dirs} AS path, CASE WHEN doc_id % 13 <> 0 THEN sha256(text) END AS expected, CASE WHEN doc_id % 11 <> 0 THEN sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) END AS actual,
      CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'new' WHEN doc_id % 10 = 0 THEN 'changed' END AS change, doc_id FROM documents) WHERE change IS NOT NULL AND NOT (doc_id % 11 = 0 AND doc_id % 13 = 0))"""
    cat.add("i03_checksum_changes", sums, f"WITH {chg} SELECT path, expected, actual, change FROM chg")
    cat.add("i04_violations", lambda sp, sf: I.violations(sums(sp, sf)).select("path", "change", "violation_type", "severity"),
            f"""WITH {chg} SELECT path, change, CASE doc_id % 4 WHEN 0 THEN 'config_' WHEN 1 THEN 'audit_log_' ELSE 'file_' END || change AS violation_type, CASE WHEN doc_id % 4 < 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM chg WHERE change <> 'new'""")
    cat.add("i04_violation_counts", lambda sp, sf: I.violation_counts(threats(sp, sf), t("2024-01-20")),
            S.sql("audit", """SELECT count(*) AS total_violations, count_if("timestamp" > TIMESTAMP '2024-01-19 00:00:00')::BIGINT AS recent_violations FROM thr""", THREATS))

    def backups(sp, sf):
        return X.read_table(sp, sf, "orders").select(F.col("o_orderkey").alias("backup_id"), F.expr("timestamp_micros(1700000000000000 + o_orderkey * 60000000)").alias("timestamp"))
    cat.add("i04_retained_backups", lambda sp, sf: I.retained_backups(backups(sp, sf), t("2024-02-20 00:00:00"), 90, 10),
            """WITH bk AS (SELECT o_orderkey AS backup_id, make_timestamp(1700000000000000 + o_orderkey * 60000000) AS "timestamp" FROM orders)
             SELECT * FROM bk WHERE "timestamp" >= TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 90 DAY OR backup_id IN (SELECT backup_id FROM bk ORDER BY "timestamp" DESC, backup_id DESC LIMIT 10)""", ts=("timestamp",))
    cat.add("i05_health_history", lambda sp, sf: C.health_history(checks(sp, sf)),
            S.sql("audit", """SELECT 'c' || CAST(event_id % 6 AS VARCHAR) AS component, CASE WHEN k % 3 <> 0 THEN 'healthy' ELSE 'unhealthy' END AS status, count(*) AS n, max("timestamp") AS last_check FROM audit GROUP BY 1, 2"""), ts=("last_check",))
    cat.add("i06_retained_detections", lambda sp, sf: I.retained(threats(sp, sf), t("2024-01-20"), 2).select("event_id", "threat_type"),
            S.sql("audit", """SELECT event_id, threat_type FROM thr WHERE "timestamp" >= TIMESTAMP '2024-01-18 00:00:00'""", THREATS))
    cat.add("i06_newest_per_type", lambda sp, sf: I.newest_per(threats(sp, sf), ["threat_type"], 100, ("timestamp", "event_id")).select("event_id", "threat_type"),
            S.sql("audit", """SELECT event_id, threat_type FROM thr QUALIFY row_number() OVER (PARTITION BY threat_type ORDER BY "timestamp" DESC, event_id DESC) <= 100""", THREATS))
