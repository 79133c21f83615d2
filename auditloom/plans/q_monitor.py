"""Self-monitoring: risk scores, attack patterns and advanced threats."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.joins import spread
from auditloom.monitor import library as L
from auditloom.monitor import patterns as P
from auditloom.monitor import risk as R
from auditloom.monitor import search as K
from auditloom.operators import features as FE
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import audit
from auditloom.plans.q_features import STMTS, q, stm
from auditloom import fixtures as X

ACCOUNT = "user_0"

# --- derived inputs --------------------------------------------------------------------------------------------------
_EVENT = """CASE k % 3 WHEN 0 THEN 'database_connection' WHEN 1 THEN 'query_executed' ELSE 'schema_access' END"""
_IP = "CASE WHEN k % 7 = 0 THEN 'localhost' ELSE client_ip END"
_COMPONENT = "CASE k % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(L.COMPONENTS)) + " END"
_ARGUMENT = """CASE WHEN k % 10 = 0 THEN 'SELECT SLEEP(5), HEX(a) FROM t LIMIT 50000' WHEN k % 10 = 3 THEN 'select hex (a), concat(b), concat(c), concat( d )      from t /* x */ where ''a'' = ''a'' and ''b'' = ''b'''
 WHEN k % 50 = 7 THEN 'CREATE TRIGGER t1 AFTER INSERT ON a FOR EACH ROW SET x = random(1)' WHEN k % 50 = 8 THEN 'or 1 = 1 and 2 = 2 or 3 = 3' ELSE '' END"""
_COMMAND = "CASE k % 4 WHEN 0 THEN 'Query' WHEN 1 THEN 'Execute' WHEN 2 THEN 'Prepare' ELSE '' END"


def infra(sp, sf):
    """Monitoring events derived from the audit rows."""
    return audit(sp, sf).selectExpr(
        "event_id", "timestamp", f"{_EVENT} AS event_type", f"{_IP} AS source_ip", "user AS user_account", f"{_COMPONENT} AS target_component",
        f"map('query', query, 'database', database, 'command', {_COMMAND}, 'argument', {_ARGUMENT}, 'duration', CAST(k % 50 AS STRING)) AS action_details",
        "k / 100.0D AS risk_score")


INFRA = f"""infra AS (SELECT event_id, "timestamp", {_EVENT} AS event_type, {_IP} AS source_ip, "user" AS user_account, {_COMPONENT} AS target_component,
 query, "database", {_COMMAND} AS command, {_ARGUMENT} AS argument, k % 50 AS duration, k / 100.0::DOUBLE AS risk_score, k FROM audit),
content AS (SELECT *, query || ' ' || '' || ' ' || argument AS content FROM infra)"""


def processlist(sp, sf):
    """Hourly process lists of two servers: the newest event of each connection id."""
    rows = audit(sp, sf).selectExpr(
        "date_trunc('HOUR', timestamp) AS snapshot_ts", "event_id % 40 AS Id", "event_id", "struct(CASE WHEN k % 9 = 0 THEN 'audit_monitor' ELSE user END AS User,"
        "CASE WHEN k % 7 = 0 THEN 'localhost' ELSE concat(client_ip, ':3306') END AS Host, database AS db,"
        "CASE k % 6 WHEN 0 THEN 'Binlog Dump' WHEN 1 THEN 'Query' WHEN 2 THEN 'Sleep' WHEN 3 THEN 'Create DB' WHEN 4 THEN 'Change user' ELSE 'Query' END AS Command,"
        "CAST(k * 60 AS BIGINT) AS Time) AS s")
    return rows.groupBy("snapshot_ts", "Id").agg(F.max_by("s", "event_id").alias("s")).select(
        "snapshot_ts", "Id", (F.col("Id") % 2).alias("server"), "s.*")


PROCESSLIST = """pl AS (SELECT snapshot_ts, "Id", "Id" % 2 AS server, s.u AS "User", s.h AS "Host", s.d AS db, s.c AS "Command", s.t AS "Time" FROM (
 SELECT date_trunc('hour', "timestamp") AS snapshot_ts, event_id % 40 AS "Id", arg_max({'u': CASE WHEN k % 9 = 0 THEN 'audit_monitor' ELSE "user" END,
  'h': CASE WHEN k % 7 = 0 THEN 'localhost' ELSE concat(client_ip, ':3306') END, 'd': "database",
  'c': CASE k % 6 WHEN 0 THEN 'Binlog Dump' WHEN 1 THEN 'Query' WHEN 2 THEN 'Sleep' WHEN 3 THEN 'Create DB' WHEN 4 THEN 'Change user' ELSE 'Query' END,
  't': CAST(k * 60 AS BIGINT)}, event_id) AS s FROM audit GROUP BY 1, 2)),
ps AS (SELECT *, count(*) OVER (PARTITION BY snapshot_ts, "User") AS user_sessions FROM pl)"""
_NAMES = tuple(L.TABLE_LEVELS) + ("other_counter",)
_TABLE = f"CASE event_id % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_NAMES)) + " END"


def table_io(sp, sf):
    return audit(sp, sf).selectExpr(
        f"{_TABLE} AS object_name", "k").selectExpr("*", "CASE WHEN k % 9 = 0 THEN 'other' ELSE 'performance_schema' END AS object_schema").groupBy(
        "object_schema", "object_name").agg(*[F.sum(F.expr(e)).alias(n) for n, e in IO.items()])


IO = {"count_read": "k % 3", "count_write": "CASE WHEN k = 50 THEN 1 ELSE 0 END", "count_fetch": "k % 2", "count_insert": "CASE WHEN k = 51 THEN 1 ELSE 0 END",
      "count_update": "CASE WHEN k = 52 THEN 1 ELSE 0 END", "count_delete": "0", "count_misc": "k % 5"}
TABLE_IO = (f"io AS (SELECT object_schema, object_name, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in IO.items())
            + f" FROM (SELECT *, {_TABLE} AS object_name, CASE WHEN k % 9 = 0 THEN 'other' ELSE 'performance_schema' END AS object_schema FROM audit) GROUP BY ALL)")
LEVEL = "CASE object_name " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in L.TABLE_LEVELS.items()) + " ELSE 'none' END"


def access(sp, sf):
    return audit(sp, sf).selectExpr("event_id", "timestamp", "user", "concat('host_', event_id % 2) AS host", f"{_TABLE} AS table_name",
                                    "CAST(k % 4 AS BIGINT) AS access_count", "k / 100.0D AS risk")


ACCESS = f"""acc AS (SELECT event_id, "timestamp", "user", concat('host_', CAST(event_id % 2 AS VARCHAR)) AS host, {_TABLE} AS table_name, CAST(k % 4 AS BIGINT) AS access_count, k / 100.0::DOUBLE AS risk FROM audit)"""


def probes(sp, sf):
    """Statements that probe the server, from the orders."""
    return spread(X.read_table(sp, sf, "orders")).selectExpr("o_orderkey AS id", "CAST(o_custkey % 100 AS INT) AS k", f"{_probe_sql('o_orderkey')} AS query",
                                                     "CAST(o_custkey * 7 % 2000 AS BIGINT) AS rows_returned")


_PROBES = (
    "SELECT user, host FROM performance_schema.accounts", "show full processlist", "SELECT table_name FROM information_schema.tables",
    "SELECT * FROM performance_schema.global_variables WHERE variable_name LIKE '%password%'", "GRANT ALL PRIVILEGES ON *.* TO x WITH GRANT OPTION",
    "describe audit_store.audit_log", "SELECT 1; DROP TABLE t", "select version ( ), @@version", "x' OR '1'='1",
    "SELECT thread_id, processlist_id, user FROM performance_schema.threads", "UPDATE audit_log SET a = 1", "SHOW GRANTS", "SELECT a FROM b",
    "SELECT authentication_string, sleep (1) FROM mysql.user INTO OUTFILE 'x'", "SET PASSWORD = 'x'")


def _probe_sql(col: str) -> str:
    return f"CASE {col} % {len(_PROBES)} " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(_PROBES)) + " END"


PROBES = f"probes AS (SELECT o_orderkey AS id, CAST(o_custkey % 100 AS INT) AS k, {_probe_sql('o_orderkey')} AS query, CAST(o_custkey * 7 % 2000 AS BIGINT) AS rows_returned FROM orders)"


def n_matches(regexes, col="query"):
    return "(" + " + ".join(f"CAST(regexp_matches({col}, {q(r)}) AS INTEGER)" for r in regexes) + ")"


def names_sql(*parts):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {n if n.startswith(chr(39)) or '||' in n else q(n)} END" for c, n in parts) + ")"


def in_list(values):
    return "(" + ", ".join(q(v) for v in values) + ")"


def w(cond, weight):
    return f"CASE WHEN {cond} THEN {weight}::DOUBLE ELSE 0 END"


def register(cat: Catalog) -> None:
    _risk(cat)
    _attack(cat)
    _advanced(cat)


def _risk(cat: Catalog) -> None:
    known = ("root", "mysql.sys", "mysql.session", "audit_monitor", "user_1")
    host = "split_part(\"Host\", ':', 1)"
    full = f"""least(round({w('"User" NOT IN ' + in_list(known), 0.5)} + {w(host + " NOT IN " + in_list(L.LOCAL_HOSTS), 0.3)} + {w('db IN ' + in_list(L.SYSTEM_DATABASES), 0.4)}
      + {w('"Command" IN ' + in_list(L.ADMIN_PROCESS_COMMANDS), 0.3)} + {w('user_sessions >= 3', 0.4)}, 9), 1.0)"""
    basic = f"""least(round({w('"User" NOT IN ' + in_list(known), 0.5)} + {w('"Host" NOT IN ' + in_list(L.LOCAL_HOSTS), 0.3)}
      + {w('user_sessions >= 2', 0.4)} + {w('"Command" IN ' + in_list(L.ADMIN_PROCESS_COMMANDS), 0.3)}, 9), 1.0)"""
    cols = ("snapshot_ts", "Id", "User", "user_sessions", "risk_score")
    sel = 'snapshot_ts, "Id", "User", user_sessions'
    cat.add("t01_connection_risk", lambda sp, sf: R.connection_risk(processlist(sp, sf), known).select(*cols),
            S.sql("audit", f"SELECT {sel}, {full} AS risk_score FROM ps", PROCESSLIST), ts=("snapshot_ts",), rnd={"risk_score": 6})
    cat.add("t02_connection_risk_basic", lambda sp, sf: R.connection_risk_basic(processlist(sp, sf), known).select(*cols),
            S.sql("audit", f"SELECT {sel}, {basic} AS risk_score FROM ps", PROCESSLIST), ts=("snapshot_ts",), rnd={"risk_score": 6})
    cmds = tuple(c for c in L.ADMIN_PROCESS_COMMANDS if c != "Change user")
    rem, adm, lng, many = '"Host" NOT IN ' + in_list(L.LOCAL_HOSTS), '"Command" IN ' + in_list(cmds), '"Time" > 3600', "user_sessions > 2"
    cat.add("t03_privileged_account", lambda sp, sf: R.privileged_account_anomalies(R.connection_risk(processlist(sp, sf), known), "audit_monitor").select(
        "snapshot_ts", "Id", "indicators", "updated_risk"),
        S.sql("audit", f"""SELECT * FROM (SELECT snapshot_ts, "Id", {names_sql((rem, 'remote_connection'), (adm, "'admin_command:' || " + '"Command"'), (lng, 'long_running_connection'),
          (many, "'multiple_sessions:' || CAST(user_sessions AS VARCHAR)"))} AS indicators,
         least(round({full} + {w(rem, 0.4)} + {w(adm, 0.5)} + {w(lng, 0.3)} + {w(many, 0.4)}, 9), 1.0) AS updated_risk FROM ps WHERE "User" = 'audit_monitor') WHERE indicators <> ''""", PROCESSLIST),
        ts=("snapshot_ts",), rnd={"updated_risk": 6})
    life = """t AS (SELECT server, snapshot_ts, lag(snapshot_ts) OVER w AS prev_ts, lead(snapshot_ts) OVER w AS next_ts FROM (SELECT DISTINCT server, snapshot_ts FROM pl) WINDOW w AS (PARTITION BY server ORDER BY snapshot_ts)),
     l1 AS (SELECT pl.*, prev_ts, next_ts, lag(pl.snapshot_ts) OVER w AS seen, lead(pl.snapshot_ts) OVER w AS nxt FROM pl JOIN t ON t.server = pl.server AND t.snapshot_ts = pl.snapshot_ts
      WINDOW w AS (PARTITION BY pl.server, "Id" ORDER BY pl.snapshot_ts)),
     l2 AS (SELECT *, coalesce(seen = prev_ts, false) AS was, coalesce(nxt = next_ts, false) AS stays FROM l1),
     l3 AS (SELECT *, last_value(CASE WHEN NOT was THEN snapshot_ts END IGNORE NULLS) OVER (PARTITION BY server, "Id" ORDER BY snapshot_ts) AS opened_at FROM l2)"""
    cat.add("t04_connection_lifecycle", lambda sp, sf: R.connection_lifecycle(processlist(sp, sf)),
            S.sql("audit", """SELECT server, "Id", "User", "Host", CASE WHEN was THEN 'updated' ELSE 'opened' END AS change, snapshot_ts AS at, CAST(NULL AS DOUBLE) AS duration_sec FROM l3
             UNION ALL SELECT server, "Id", "User", "Host", 'closed', next_ts, (epoch_us(next_ts) - epoch_us(opened_at)) / 1e6::DOUBLE FROM l3 WHERE NOT stays AND next_ts IS NOT NULL""", PROCESSLIST, life),
            ts=("at",), rnd={"duration_sec": 6})

    def logins(sp, sf):
        return audit(sp, sf).selectExpr("event_id", "timestamp AS ts", "concat(client_ip, ':99') AS host", "CASE WHEN k % 2 = 0 THEN 'login' ELSE 'idle' END AS state",
                                        "CASE WHEN k % 10 < 8 THEN 0.4D ELSE 3.0D END AS duration_sec")
    cat.add("t05_login_failures", lambda sp, sf: R.login_failures(logins(sp, sf), 2).select("event_id", "host", "failures", "risk_score"),
            S.sql("audit", """SELECT event_id, host, failures, 0.9::DOUBLE AS risk_score FROM (SELECT event_id, client_ip AS host, count(*) OVER (PARTITION BY client_ip ORDER BY epoch_us("timestamp")
             RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS failures FROM audit WHERE k % 2 = 0 AND k % 10 < 8) WHERE failures >= 2"""))
    mal, rec, esc = n_matches(L.MALICIOUS), n_matches(L.RECONNAISSANCE), n_matches(L.ESCALATION)
    tam, per = "contains(lower(query), 'audit_log')", "contains(lower(query), 'performance_schema')"
    cat.add("t06_statement_threats", lambda sp, sf: R.statement_threats(probes(sp, sf)).select(
        "id", "risk_score", "is_high_risk", "categories", F.size("patterns").alias("n_patterns")),
        "WITH " + PROBES + f""" SELECT id, least(s, 1.0) AS risk_score, s >= 0.6 AS is_high_risk, categories, n AS n_patterns FROM (
         SELECT id, {mal} + {rec} + {esc} AS n, round({mal} * 0.3::DOUBLE + {rec} * 0.4::DOUBLE + {esc} * 0.6::DOUBLE + {w(tam, 0.5)} + {w(per, 0.4)}, 9) AS s,
         {names_sql((mal + ' > 0', 'malicious_query'), (rec + ' > 0', 'reconnaissance'), (esc + ' > 0', 'privilege_escalation'), (tam, 'audit_log_tampering'), (per, 'performance_schema_access'))} AS categories
         FROM probes WHERE length(query) >= 10) WHERE s >= 0.3 OR n > 0""", rnd={"risk_score": 6})
    sus = n_matches([f"(?i){r}" for r in L.SUSPICIOUS])
    words = "(" + " + ".join(f"CAST(contains(upper(query), {q(x)}) AS INTEGER)" for x in L.PRIVILEGE_WORDS) + ")"
    cat.add("t07_suspicious_statements", lambda sp, sf: R.suspicious_statements(probes(sp, sf)).select("id", "risk_score", "n_patterns", F.size("words").alias("n_words")),
            "WITH " + PROBES + f""" SELECT id, least(s, 1.0) AS risk_score, {sus} AS n_patterns, {words} AS n_words FROM (SELECT *, round({sus} * 0.3::DOUBLE + {words} * 0.4::DOUBLE
             + {w("contains(lower(query), 'information_schema')", 0.5)}, 9) AS s FROM probes) WHERE s >= 0.3""", rnd={"risk_score": 6})
    ios = "SELECT *, count_write + count_insert + count_update + count_delete AS total_writes, count_read + count_fetch + count_write + count_insert + count_update + count_delete AS total_access, " + LEVEL + " AS lvl FROM io WHERE object_schema = 'performance_schema' AND (count_read > 0 OR count_write > 0 OR count_fetch > 0)"
    lims = (("lvl = 'critical'", 0.8, "critical_table_access"), ("lvl = 'high'", 0.6, "high_risk_table_access"), ("lvl = 'medium'", 0.4, "medium_risk_table_access"),
            ("total_access > 1000", 0.3, "excessive_access_count"), ("total_access > 100 AND total_access <= 1000", 0.2, "high_access_count"),
            ("total_writes > 0 AND object_name IN ('accounts', 'users', 'hosts')", 0.5, "unexpected_write_operations"))
    cat.add("t08_counter_risk", lambda sp, sf: R.counter_risk(table_io(sp, sf)).select("object_name", "total_access", "access_type", "risk_score", "indicators"),
            S.sql("audit", f"""SELECT object_name, total_access, CASE WHEN total_writes = 0 THEN 'read' ELSE 'write' END AS access_type,
             least(round({' + '.join(w(c, x) for c, x, _ in lims)}, 9), 1.0) AS risk_score, {names_sql(*[(c, n) for c, _, n in lims])} AS indicators FROM ({ios}) x
             WHERE total_access > 0 AND ({' OR '.join(c for c, _, _ in lims)})""", TABLE_IO), rnd={"risk_score": 6})
    cat.add("t08_counter_risk_basic", lambda sp, sf: R.counter_risk_basic(table_io(sp, sf)).select("object_name", "total_access", "risk_score"),
            S.sql("audit", f"""SELECT * FROM (SELECT object_name, count_read + count_write + count_misc AS total_access, least(round({w('object_name IN ' + in_list(L.SENSITIVE_COUNTERS), 0.6)}
             + {w('count_read + count_write + count_misc > 100', 0.3)}, 9), 1.0) AS risk_score FROM io WHERE object_schema = 'performance_schema') WHERE risk_score >= 0.5""", TABLE_IO), rnd={"risk_score": 6})
    parts = [f"{n_matches(r)} * {x}::DOUBLE" for _, x, r in L.COUNTER_RECON] + [f"{n_matches(L.CREDENTIALS)} * 0.8::DOUBLE",
             "CASE WHEN rows_returned > 1000 THEN 0.4::DOUBLE WHEN rows_returned > 100 THEN 0.2::DOUBLE ELSE 0 END"]
    parts += [w(f"contains(lower(query), '{t}')", 0.6 if v == "critical" else 0.4) for t, v in L.TABLE_LEVELS.items() if v in ("critical", "high")]
    inds = ([(f"{n_matches(r)} > 0", n) for n, _, r in L.COUNTER_RECON] + [(f"{n_matches(L.CREDENTIALS)} > 0", "credential_extraction_attempt"),
            ("rows_returned > 1000", "bulk_data_extraction"), ("rows_returned > 100 AND rows_returned <= 1000", "large_result_set")]
            + [(f"contains(lower(query), '{t}')", f"{'critical' if v == 'critical' else 'high_risk'}_table_query:{t}") for t, v in L.TABLE_LEVELS.items() if v in ("critical", "high")])
    cat.add("t09_counter_query_risk", lambda sp, sf: R.counter_query_risk(probes(sp, sf)).select("id", "risk_score", "is_high_risk", "indicators"),
            "WITH " + PROBES + f""" SELECT id, least(s, 1.0) AS risk_score, s >= 0.7 AS is_high_risk, indicators FROM (SELECT id, round({' + '.join(parts)}, 9) AS s, {names_sql(*inds)} AS indicators
             FROM probes WHERE length(query) >= 10) WHERE s >= 0.3 OR indicators <> ''""", rnd={"risk_score": 6})
    risk = "CASE table_name " + " ".join(f"WHEN '{t}' THEN {dict(critical=1.0, high=0.8, medium=0.6, low=0.4)[v]}" for t, v in L.TABLE_LEVELS.items()) + " ELSE 0.1 END"
    rs = (("sens >= 3", 0.8, "systematic_sensitive_table_enumeration"), ("sens = 2", 0.6, "multiple_sensitive_table_access"),
          ("span < 60 AND n >= 5", 0.5, "rapid_fire_access"), ("r1 > r0", 0.4, "escalating_access_pattern"))
    cat.add("t10_recon_sessions", lambda sp, sf: R.recon_sessions(access(sp, sf), "60 minutes"),
            S.sql("audit", f"""SELECT "user", host, window_start, n AS access_count, sens AS sensitive_tables, span AS time_span_sec, indicators, least(p, 1.0) AS risk_score FROM (
             SELECT *, round({' + '.join(w(c, x) for c, x, _ in rs)}, 9) AS p, {names_sql(*[(c, n) for c, _, n in rs])} AS indicators FROM (
              SELECT "user", host, time_bucket(INTERVAL 60 MINUTE, "timestamp") AS window_start, count(*) AS n, count(DISTINCT CASE WHEN table_name <> 'other_counter' THEN table_name END) AS sens,
               (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6::DOUBLE AS span, arg_max({risk}, ("timestamp", event_id)) AS r1, arg_min({risk}, ("timestamp", event_id)) AS r0
              FROM acc GROUP BY 1, 2, 3 HAVING count(*) >= 3)) WHERE p >= 0.5""", ACCESS), ts=("window_start",), rnd={"risk_score": 6, "time_span_sec": 6})
    cat.add("t11_access_counts", lambda sp, sf: R.access_counts(access(sp, sf)),
            S.sql("audit", 'SELECT table_name, "user", CAST(sum(access_count) AS BIGINT) AS access_count FROM acc GROUP BY ALL', ACCESS))
    cat.add("t11_normal_tables", lambda sp, sf: R.normal_tables(access(sp, sf), F.lit("2024-01-01").cast("timestamp"), 86_400),
            S.sql("audit", """SELECT DISTINCT "user", table_name FROM acc WHERE "timestamp" <= TIMESTAMP '2024-01-02 00:00:00'""", ACCESS))
    first = "CASE " + " ".join(f"WHEN regexp_matches(query, {q(r)}) THEN {q(r)}" for r in L.CREDENTIALS) + " END"
    cat.add("t12_credential_block", lambda sp, sf: R.credential_block(probes(sp, sf)).select("id", "pattern"),
            "WITH " + PROBES + f" SELECT * FROM (SELECT id, {first} AS pattern FROM probes) WHERE pattern IS NOT NULL")
    cat.add("t13_events_between", lambda sp, sf: R.events_between(infra(sp, sf), F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-05").cast("timestamp")).select("event_id", "event_type"),
            S.sql("audit", """SELECT event_id, event_type FROM infra WHERE "timestamp" BETWEEN '2024-01-03' AND '2024-01-05'""", INFRA))
    cat.add("t13_newest_events", lambda sp, sf: R.newest_events(infra(sp, sf), 1000).select("event_id", "event_type"),
            S.sql("audit", """SELECT event_id, event_type FROM infra ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000""", INFRA))
    cat.add("t14_drop_repeats", lambda sp, sf: R.drop_repeats(infra(sp, sf).withColumn("source_ip", F.lit("x")), 7200).select("event_id", "user_account", "event_type"),
            chain_sql("audit", [INFRA, """al AS (SELECT event_id, user_account, event_type, "timestamp", concat_ws(':', event_type, user_account, target_component) AS key FROM infra)"""],
                      "event_id, user_account, event_type", 7_200_000_000))

    def keyword_patterns(sp, sf):
        """A pattern table built from the nations: a keyword and a regex each."""
        return X.read_table(sp, sf, "nation").selectExpr("concat('p', n_nationkey) AS pattern_id",
            "element_at(array('schema', 'grant', 'sleep', 'audit', 'select'), CAST(n_nationkey % 5 + 1 AS INT)) AS keyword",
            "element_at(array('from\\\\s+\\\\w+', 'to\\\\s+x', 'sleep\\\\s*', '', 'where'), CAST(n_nationkey % 5 + 1 AS INT)) AS regex")
    cat.add("t15_keyword_search", lambda sp, sf: K.keyword_search(probes(sp, sf), keyword_patterns(sp, sf)).select("id", "pattern_ids"),
            "WITH " + PROBES + r""", pt AS (SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS pid, (['schema', 'grant', 'sleep', 'audit', 'select'])[n_nationkey % 5 + 1] AS kw,
             (['from\s+\w+', 'to\s+x', 'sleep\s*', '', 'where'])[n_nationkey % 5 + 1] AS rx FROM nation)
             SELECT id, list_sort(list(DISTINCT pid)) AS pattern_ids FROM probes JOIN pt ON contains(lower(query), kw) AND regexp_matches(query, '(?i)' || rx) GROUP BY id""", arr=("pattern_ids",))
    cat.add("w07_escalation_trend", lambda sp, sf: R.escalation_trend(access(sp, sf), ["user", "host"]),
            S.sql("audit", """SELECT "user", host, count(*) AS n, arg_min(risk, ("timestamp", event_id)) AS first_risk, arg_max(risk, ("timestamp", event_id)) AS last_risk,
             count(*) >= 3 AND arg_max(risk, ("timestamp", event_id)) > arg_min(risk, ("timestamp", event_id)) AS escalating FROM acc GROUP BY ALL""", ACCESS), rnd={"first_risk": 6, "last_risk": 6})


def chain_sql(layer: str, ctes: list[str], cols: str, gap_us: int) -> str:
    """Rows of ``al`` (key, timestamp) kept at least a gap apart, by walking each key in order."""
    parts = [p.strip() for p in S._LAYERS[layer]] + ctes + [
        "nodes AS (SELECT DISTINCT key, epoch_us(\"timestamp\") AS t FROM al)",
        f"kept AS (SELECT key, min(t) AS t FROM nodes GROUP BY key UNION ALL SELECT k.key, (SELECT min(n.t) FROM nodes n WHERE n.key = k.key AND n.t >= k.t + {gap_us}) FROM kept k "
        f"WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.key = k.key AND n.t >= k.t + {gap_us}))"]
    return "WITH RECURSIVE " + ",\n".join(parts) + f'\nSELECT {cols} FROM al WHERE (key, epoch_us("timestamp")) IN (SELECT (key, t) FROM kept)'


_OFF = '(hour("timestamp") < 6 OR hour("timestamp") > 22)'
_REMOTE = "source_ip NOT IN " + in_list(L.LOCAL_HOSTS)
MATCHES = "matches AS (" + " UNION ALL ".join(
    f"""SELECT *, '{p.pattern_id}' AS pattern_id, '{p.attack_type}' AS attack_type, {p.weight}::DOUBLE AS weight,
    unnest(list_distinct(flatten([{', '.join(f"regexp_extract_all(c, {q(r)})" for r in p.regexes)}]))) AS matched FROM src""" for p in L.ATTACK_PATTERNS) + ")"
SRC = "src AS (SELECT *, 'query' AS content_type, query AS c FROM infra WHERE length(query) >= 5 UNION ALL SELECT *, 'argument', argument FROM infra WHERE length(argument) >= 5)"
_LIM = "CASE attack_type " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in L.CONFIDENCE_LIMITS.items()) + " ELSE 0.7 END"
INDICATORS = f"""ind AS (SELECT * FROM (SELECT *, least(round(weight + {w(f"user_account = '{ACCOUNT}'", 0.2)} + {w('"database" IN ' + in_list(L.SYSTEM_DATABASES), 0.15)} + {w(_REMOTE, 0.1)}
 + {w('length(matched) > 20', 0.05)} + {w(_OFF, 0.1)}, 9), 1.0) AS confidence FROM matches) WHERE confidence >= {_LIM})"""
_BASE = "CASE attack_type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in L.BASE_SEVERITY.items()) + " END"
THREATS = f"""threats AS (SELECT *, CASE WHEN confidence_score >= 0.9 AND b = 'medium' THEN 'high' WHEN confidence_score >= 0.9 AND b = 'high' THEN 'critical'
 WHEN confidence_score < 0.6 AND b = 'critical' THEN 'high' WHEN confidence_score < 0.6 AND b = 'high' THEN 'medium' ELSE b END AS severity FROM (
 SELECT attack_type, source_ip, user_account, count(*) AS event_count, round(avg(confidence), 9) AS confidence_score,
 (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6::DOUBLE AS time_span_sec, list_sort(list(DISTINCT pattern_id)) AS patterns, max("timestamp") AS "timestamp", {_BASE} AS b
 FROM ind GROUP BY attack_type, source_ip, user_account))"""


def actions_sql() -> str:
    typed = " ".join(f"WHEN '{t}' THEN {list(a)!r}" for t, a in L.TYPE_ACTIONS.items())
    return (f"list_sort(list_concat({list(L.BASE_ACTIONS)!r}, CASE attack_type {typed} ELSE [] END, CASE WHEN severity IN ('high', 'critical') THEN {list(L.HIGH_ACTIONS)!r} ELSE [] END, "
            f"CASE WHEN severity = 'critical' THEN {list(L.CRITICAL_ACTIONS)!r} ELSE [] END))")


def indicators(sp, sf):
    return P.attack_indicators(infra(sp, sf), ACCOUNT)


def _attack(cat: Catalog) -> None:
    base = (INFRA, SRC, MATCHES)
    cat.add("a01_attack_matches", lambda sp, sf: P.attack_matches(infra(sp, sf)).select("event_id", "content_type", "pattern_id", "attack_type", "matched"),
            S.sql("audit", "SELECT event_id, content_type, pattern_id, attack_type, matched FROM matches", *base))
    cat.add("a02_attack_confidence", lambda sp, sf: indicators(sp, sf).select("event_id", "content_type", "pattern_id", "matched", "confidence"),
            S.sql("audit", "SELECT event_id, content_type, pattern_id, matched, confidence FROM ind", *base, INDICATORS), rnd={"confidence": 6})
    cat.add("a03_attack_threats", lambda sp, sf: P.attack_threats(indicators(sp, sf)).select(
        "attack_type", "source_ip", "user_account", "event_count", "confidence_score", "time_span_sec", "patterns", "severity", "threat_type", "response_actions"),
        S.sql("audit", f"""SELECT attack_type, source_ip, user_account, event_count, confidence_score, time_span_sec, patterns, severity, 'attack_pattern_' || attack_type AS threat_type,
         {actions_sql()} AS response_actions FROM threats""", *base, INDICATORS, THREATS), arr=("patterns", "response_actions"), rnd={"confidence_score": 6, "time_span_sec": 6})
    seq = """gaps AS (SELECT *, coalesce(epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w) > 3600000000, true) AS s FROM ind
       WINDOW w AS (PARTITION BY source_ip, user_account, attack_type ORDER BY "timestamp", event_id)),
      runs AS (SELECT *, last_value(CASE WHEN s THEN "timestamp" END IGNORE NULLS) OVER (PARTITION BY source_ip, user_account, attack_type ORDER BY "timestamp", event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM gaps)"""
    cat.add("a04_attack_sequences", lambda sp, sf: P.attack_sequences(indicators(sp, sf), 3600, 2, F.lit("2024-01-30 12:00:00").cast("timestamp"), 86_400),
            S.sql("audit", """SELECT source_ip, user_account, attack_type, session_start, count(*) AS event_count, max("timestamp") AS end_time, round(avg(confidence), 9) AS confidence_score,
             epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max("timestamp")) <= 86400000000 AS is_active FROM runs GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""", *base, INDICATORS, seq),
            ts=("session_start", "end_time"), rnd={"confidence_score": 6})
    cat.add("a05_recent_detections", lambda sp, sf: P.recent(indicators(sp, sf), F.lit("2024-01-20").cast("timestamp"), 24).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n")),
            S.sql("audit", """SELECT attack_type, count(*) AS n FROM ind WHERE "timestamp" >= TIMESTAMP '2024-01-19 00:00:00' GROUP BY 1""", *base, INDICATORS))


def mech_sql(library, extra: str, limit: float, name: str, cte: str) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT *, '{m.name}' AS {name}, {q(r)} AS pattern, {m.stealth}::DOUBLE AS stealth, ({' + '.join(f"CAST(contains(lower(content), '{x}') AS INTEGER)" for x in m.words)}) * 0.1::DOUBLE AS words
        FROM content WHERE length(content) >= 10 AND regexp_matches(content, {q(r)})""" for m in library for r in m.regexes)
    return f"{cte} AS (SELECT * FROM (SELECT *, least(round({extra}, 9), 1.0) AS confidence FROM ({rows}) z) WHERE confidence >= {limit})"


PERSIST = mech_sql(L.MECHANISMS, f"""0.7::DOUBLE + stealth * 0.2::DOUBLE + CASE WHEN user_account = '{ACCOUNT}' THEN 0.3::DOUBLE WHEN user_account IN ('root', 'admin', 'administrator') THEN 0.2::DOUBLE ELSE 0 END
 + words + {w(_OFF, 0.15)} + {w(_REMOTE, 0.1)} + {w('length(content) > 200', 0.05)}""", 0.85, "mechanism", "pers")
EXFIL = mech_sql(L.EXFILTRATION, f"""0.6::DOUBLE + words + {w('length(content) > 1000', 0.2)} + {w('length(content) > 500 AND length(content) <= 1000', 0.1)} + {w(_OFF, 0.15)}
 + {w(f"user_account = '{ACCOUNT}'", 0.25)} + {w(_REMOTE, 0.15)}""", 0.6, "method", "exf")
VOLUME = """vol AS (SELECT *, (v - mv) / sd AS deviation_factor, least(0.8::DOUBLE, 0.5::DOUBLE + (v - mv) / sd * 0.1::DOUBLE) AS confidence FROM (
 SELECT *, length(query) AS v, avg(length(query)) OVER k AS mv, stddev_samp(length(query)) OVER k AS sd, count(*) OVER k AS n FROM infra WINDOW k AS (PARTITION BY user_account, source_ip))
 WHERE n >= 5 AND v > mv + 1.2::DOUBLE * sd)"""
TIMING = """gp AS (SELECT user_account, source_ip, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w)) / 1e6 AS g FROM infra WINDOW w AS (PARTITION BY user_account, source_ip ORDER BY "timestamp", event_id)),
 gs AS (SELECT user_account, source_ip, count(*) AS n_gaps, avg(g) AS mean_gap, stddev_samp(g) AS std_gap FROM gp WHERE g IS NOT NULL GROUP BY ALL),
 gr AS (SELECT s.user_account, s.source_ip, any_value(n_gaps) AS n_gaps, any_value(mean_gap) AS mean_gap, avg(CASE WHEN abs(g - mean_gap) < std_gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS regularity
  FROM gp JOIN gs s ON s.user_account = gp.user_account AND s.source_ip = gp.source_ip WHERE g IS NOT NULL GROUP BY 1, 2),
 tim AS (SELECT r.*, m."timestamp", least(0.9::DOUBLE, 0.5::DOUBLE + regularity * 0.4::DOUBLE) AS confidence FROM gr r JOIN (SELECT user_account, source_ip, max("timestamp") AS "timestamp" FROM infra GROUP BY 1, 2) m
  ON m.user_account = r.user_account AND m.source_ip = r.source_ip WHERE regularity > 0.85 AND n_gaps + 1 >= 10)"""


def volumes(sp, sf):
    return P.volume_anomalies(infra(sp, sf), 1.2)


def timings(sp, sf):
    return P.timing_anomalies(infra(sp, sf), 1.0, 0.85)


_NORMQ = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(query), '\s+', ' ', 'g'), '''[^'']*''', '''STRING''', 'g'), '\b\d+\b', 'NUMBER', 'g'), '/\*.*?\*/', '', 'g'), '(?m)--.*$', '', 'g'), '^\s+|\s+$', '', 'g')"""
VARIATIONS = f"""pat AS (SELECT user_account, source_ip, normalized, count(*) AS n, any_value(list_distinct(list_filter(string_split_regex(normalized, '\\s+'), lambda x: x <> ''))) AS ws
  FROM (SELECT *, {_NORMQ} AS normalized FROM vinfra) GROUP BY 1, 2, 3),
 vars AS (SELECT DISTINCT a.user_account, a.source_ip, a.normalized FROM pat a JOIN pat b ON a.user_account = b.user_account AND a.source_ip = b.source_ip AND b.n > 1
  WHERE len(list_intersect(a.ws, b.ws)) / CAST(len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)) AS DOUBLE) >= 0.7
   AND len(list_intersect(a.ws, b.ws)) / CAST(len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)) AS DOUBLE) < 0.95)"""
_VTAIL = "CASE WHEN event_id % 4 = 0 THEN concat(' AND flag_', CAST(k % 6 AS STRING), ' IS NULL') WHEN event_id % 4 = 1 THEN ' ORDER BY id' ELSE '' END"


def varied(sp, sf):
    """Monitoring events whose statements come in several variations."""
    a = audit(sp, sf).withColumn("query", F.concat("query", F.expr(_VTAIL)))
    return a.selectExpr("event_id", "timestamp", f"{_EVENT} AS event_type", f"{_IP} AS source_ip", "user AS user_account", "map('query', query) AS action_details")


VARIED = f"""vinfra AS (SELECT event_id, "timestamp", {_IP} AS source_ip, "user" AS user_account, query || {_VTAIL.replace('STRING', 'VARCHAR')} AS query FROM audit)"""


def marked_variations(sp, sf):
    """The varied events with their near-duplicate sign."""
    return P.mark_variations(varied(sp, sf))


VCONTENT = f"""vcontent AS (SELECT *, query || '  ' AS content, (user_account, source_ip, {_NORMQ}) IN (SELECT (user_account, source_ip, normalized) FROM vars) AS is_variation FROM vinfra)"""


def evasion_sql() -> str:
    sign = {"excessive_whitespace": r"len(regexp_extract_all(content, '\s')) / CAST(length(content) AS DOUBLE) > 0.3", "unusual_comment_patterns": r"regexp_matches(content, '(?i)/\*.*?\*/')",
            "hex_encoded_strings": "regexp_matches(content, '(?i)0x[0-9a-f]+')", "string_concatenation_chains": r"len(regexp_extract_all(content, '(?i)concat\s*\(')) > 2",
            "artificial_delays": r"regexp_matches(content, '(?i)(?:sleep|waitfor|benchmark)\s*\(')", "randomized_timing_patterns": "contains(lower(content), 'rand')",
            "functionally_equivalent_queries": "is_variation"}
    rows = " UNION ALL ".join(
        f"""SELECT *, '{t.name}' AS technique, CAST({' + '.join(f"len(regexp_extract_all(content, {q(P._ignore_case(r))}))" for r in t.regexes)} AS INTEGER) AS obfuscation_matches,
        {' + '.join(f"CAST({sign.get(x, f'contains(lower(content), {q(x)})')} AS INTEGER)" for x in t.words)} AS behavioral_matches FROM vcontent WHERE length(content) >= 10""" for t in L.EVASION)
    return f"""eva AS (SELECT * FROM (SELECT *, least(round(0.5::DOUBLE + least(obfuscation_matches * 0.1::DOUBLE, 0.3::DOUBLE) + least(behavioral_matches * 0.15::DOUBLE, 0.3::DOUBLE)
     + {w(f"user_account = '{ACCOUNT}'", 0.2)} + {w(_OFF, 0.1)} + {w('length(content) > 500', 0.1)}, 9), 1.0) AS confidence FROM ({rows}) z WHERE obfuscation_matches > 0 OR behavioral_matches > 0) WHERE confidence >= 0.6)"""


def _advanced(cat: Catalog) -> None:
    cat.add("v01_persistence_matches", lambda sp, sf: P.mechanism_matches(infra(sp, sf), L.MECHANISMS).select("event_id", "mechanism", "pattern"),
            S.sql("audit", " UNION ALL ".join(f"SELECT event_id, '{m.name}' AS mechanism, {q(r)} AS pattern FROM content WHERE length(content) >= 10 AND regexp_matches(content, {q(r)})"
                                              for m in L.MECHANISMS for r in m.regexes), INFRA))
    cat.add("v02_persistence_threats", lambda sp, sf: P.persistence_threats(P.persistence_indicators(infra(sp, sf), ACCOUNT)),
            S.sql("audit", """SELECT *, 'persistence_' || mechanism AS threat_type, CASE WHEN confidence_score >= 0.9 OR mechanism IN ('backdoor_user', 'configuration_modification') THEN 'critical' ELSE 'high' END AS severity
             FROM (SELECT mechanism, source_ip, user_account, count(*) AS indicators_count, round(avg(confidence), 9) AS confidence_score,
              (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3.6e9::DOUBLE AS time_span_hours, list_sort(list(DISTINCT pattern)) AS patterns FROM pers GROUP BY 1, 2, 3)""", INFRA, PERSIST),
            arr=("patterns",), rnd={"confidence_score": 6, "time_span_hours": 6})
    cat.add("v03_exfiltration_indicators", lambda sp, sf: P.exfiltration_indicators(infra(sp, sf), ACCOUNT).select("event_id", "method", "pattern", "confidence"),
            S.sql("audit", "SELECT event_id, method, pattern, confidence FROM exf", INFRA, EXFIL), rnd={"confidence": 6})
    cat.add("v04_volume_anomalies", lambda sp, sf: volumes(sp, sf).select("event_id", "user_account", "volume", "deviation_factor", "confidence"),
            S.sql("audit", "SELECT event_id, user_account, v AS volume, deviation_factor, confidence FROM vol", INFRA, VOLUME), ints=("volume",), rnd={"deviation_factor": 4, "confidence": 4})
    cat.add("v05_timing_anomalies", lambda sp, sf: timings(sp, sf).select("user_account", "source_ip", "n_gaps", "mean_gap", "regularity", "timestamp", "confidence"),
            S.sql("audit", 'SELECT user_account, source_ip, n_gaps, mean_gap, regularity, "timestamp", confidence FROM tim', INFRA, TIMING), ts=("timestamp",),
            rnd={"mean_gap": 4, "regularity": 6, "confidence": 6})
    cat.add("v06_exfiltration_threats", lambda sp, sf: P.exfiltration_threats(P.exfiltration_indicators(infra(sp, sf), ACCOUNT), volumes(sp, sf), timings(sp, sf), ACCOUNT),
            S.sql("audit", f"""SELECT *, CASE WHEN user_account = '{ACCOUNT}' OR confidence_score >= 0.9 THEN 'critical' WHEN method IN ('bulk_extraction', 'covert_channel') OR confidence_score >= 0.8 THEN 'high' ELSE 'medium' END AS severity,
             'exfiltration_' || method AS threat_type FROM (SELECT source_ip, user_account, method, count(*) AS indicators_count, round(avg(confidence), 9) AS confidence_score, CAST(sum(volume) AS BIGINT) AS total_volume,
              (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7::DOUBLE AS time_span_min, list_sort(list(DISTINCT dt)) AS detection_types FROM (
              SELECT source_ip, user_account, method, 'pattern_based' AS dt, confidence, 0 AS volume, "timestamp" FROM exf UNION ALL
              SELECT source_ip, user_account, 'statistical_analysis', 'volume_anomaly', confidence, v, "timestamp" FROM vol UNION ALL
              SELECT source_ip, user_account, 'regularity_analysis', 'timing_anomaly', confidence, 0, "timestamp" FROM tim) GROUP BY 1, 2, 3)""", INFRA, EXFIL, VOLUME, TIMING),
            arr=("detection_types",), rnd={"confidence_score": 4, "time_span_min": 4})
    cat.add("v07_evasion_indicators", lambda sp, sf: P.evasion_indicators(marked_variations(sp, sf), ACCOUNT).select("event_id", "technique", "obfuscation_matches", "behavioral_matches", "confidence"),
            S.sql("audit", "SELECT event_id, technique, obfuscation_matches, behavioral_matches, confidence FROM eva", VARIED, VARIATIONS, VCONTENT, evasion_sql()), rnd={"confidence": 6})
    cat.add("v08_statement_variations", lambda sp, sf: P.variations(P.statement_patterns(varied(sp, sf))),
            S.sql("audit", "SELECT * FROM vars", VARIED, VARIATIONS))
    cat.add("v08_varied_events", lambda sp, sf: P.mark_variations(varied(sp, sf)).select("event_id", "is_variation"),
            S.sql("audit", f"""SELECT event_id, (user_account, source_ip, {_NORMQ}) IN (SELECT (user_account, source_ip, normalized) FROM vars) AS is_variation FROM vinfra""", VARIED, VARIATIONS))
    cat.add("v09_evasion_threats", lambda sp, sf: P.evasion_threats(P.evasion_indicators(marked_variations(sp, sf), ACCOUNT), ACCOUNT),
            S.sql("audit", f"""SELECT *, CASE WHEN user_account = '{ACCOUNT}' THEN 'critical' WHEN confidence_score >= 0.8 OR technique IN ('query_obfuscation', 'polymorphic_queries') THEN 'high' ELSE 'medium' END AS severity,
             'evasion_' || technique AS threat_type FROM (SELECT technique, source_ip, user_account, count(*) AS indicators_count, round(avg(confidence), 9) AS confidence_score,
              CAST(sum(obfuscation_matches) AS BIGINT) AS total_obfuscation, CAST(sum(behavioral_matches) AS BIGINT) AS total_behavioral,
              (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7::DOUBLE AS time_span_min FROM eva GROUP BY 1, 2, 3)""", VARIED, VARIATIONS, VCONTENT, evasion_sql()), rnd={"confidence_score": 6, "time_span_min": 6})

    def feed(sp, sf):
        """A threat feed derived from the documents: a name, a confidence and patterns each."""
        return X.read_table(sp, sf, "documents").selectExpr(
            "doc_id AS threat_id", "element_at(array('Credential dump', 'Web shell', 'Data exfiltration kit', 'Obfuscator'), CAST(doc_id % 4 + 1 AS INT)) AS name", "'high' AS severity",
            "CASE doc_id % 5 WHEN 0 THEN '1.7' WHEN 1 THEN 'x' WHEN 2 THEN '-1' ELSE '0.5' END AS confidence",
            "CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array(concat('p', doc_id)) ELSE array(concat('p', doc_id), '', concat('q', doc_id)) END AS detection_patterns")
    cat.add("v12_feed_patterns", lambda sp, sf: P.feed_patterns(feed(sp, sf)),
            """SELECT threat_id, name, CASE threat_id % 4 WHEN 0 THEN 'persistence_mechanism' WHEN 1 THEN 'persistence_mechanism' WHEN 2 THEN 'exfiltration_pattern' ELSE 'evasion_technique' END AS update_type,
             'high' AS severity, CASE threat_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, regex FROM (
             SELECT doc_id AS threat_id, (['Credential dump', 'Web shell', 'Data exfiltration kit', 'Obfuscator'])[doc_id % 4 + 1] AS name, unnest(CASE doc_id % 3 WHEN 1 THEN ['p' || CAST(doc_id AS VARCHAR)]
              WHEN 2 THEN ['p' || CAST(doc_id AS VARCHAR), 'q' || CAST(doc_id AS VARCHAR)] ELSE [] END) AS regex FROM documents)""", rnd={"confidence": 6})
    cat.add("v13_effectiveness", lambda sp, sf: P.effectiveness(indicators(sp, sf).groupBy(F.concat_ws(" ", "attack_type", F.date_format("timestamp", "yyyy-MM-dd HH")).alias("detection_type")).agg(F.count(F.lit(1)).alias("n"))),
            S.sql("audit", """SELECT attack_type || ' ' || strftime("timestamp", '%Y-%m-%d %H') AS detection_type, count(*) AS n, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS effectiveness, least(1.0, count(*) / 10.0) < 0.8 AS needs_update
             FROM ind GROUP BY 1""", INFRA, SRC, MATCHES, INDICATORS), rnd={"effectiveness": 6})
