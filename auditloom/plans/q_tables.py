"""Sources, sinks and read-outs over derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.operators import detect as D
from auditloom.operators import features as FE
from auditloom.operators import readouts as Q
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import CFG, audit, detection, stored
from auditloom.schema import conform
from auditloom.session import checkpoint_dir
from auditloom.sinks import tables as K
from auditloom.sources import files, general_log, geo
from auditloom.sources import statements as ST

BOOT = "2023-12-31 00:00:00"
NOW = "2024-01-30 12:30:00"


def fresh(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def register(cat: Catalog) -> None:
    _sources(cat)
    _sinks(cat)
    _readouts(cat)


# --- sources ---------------------------------------------------------------------------------------------------------
def n_threads(sp, sf):
    """Threads that statements name: one per customer, and a tenth more that no thread table knows."""
    return X.read_table(sp, sf, "customer").agg((F.count(F.lit(1)) + F.floor(F.count(F.lit(1)) / 10)).alias("n")).scalar()


def statement_events(sp, sf):
    """Statement history rows: timers in picoseconds since the boot anchor, a few rows of the monitor itself."""
    us = F.unix_micros("timestamp") - F.unix_micros(F.lit(BOOT).cast("timestamp"))
    return audit(sp, sf).select(
        "event_id", (F.col("event_id") % n_threads(sp, sf)).alias("thread_id"), (us * 1_000_000).alias("timer_start"),
        F.expr("""CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN concat(query, ' /* AUDITLOOM_EVENT */')
          ELSE query END""").alias("sql_text"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN 'audit_store' WHEN event_id % 5 = 0 THEN NULL ELSE database END").alias("current_schema"),
        "event_name", F.col("rows_returned").alias("rows_sent"), "rows_examined",
        (F.col("rows_examined") * 1_000_000_007).alias("timer_wait"), (F.col("rows_returned") * 1_000_003).alias("lock_time"))


def threads(sp, sf):
    return X.read_table(sp, sf, "customer").selectExpr(
        "c_custkey AS thread_id", "c_custkey + 100000 AS processlist_id",
        "CASE WHEN c_custkey % 29 = 0 THEN 'audit_monitor' WHEN c_custkey % 31 = 0 THEN NULL ELSE concat('user_', c_custkey % 8) END AS processlist_user",
        "concat('10.1.0.', c_custkey % 250, ':', 30000 + c_custkey) AS processlist_host")


def session_attrs(sp, sf):
    return X.read_table(sp, sf, "customer").selectExpr(
        "c_custkey + 100000 AS processlist_id",
        """explode(array(named_struct('n', 'program_name', 'v', concat('app_', c_custkey % 3)), named_struct('n', '_os', 'v', 'Linux'),
         named_struct('n', '_os', 'v', 'Zinux'), named_struct('n', '_pid', 'v', '1'))) AS a""").selectExpr(
        "processlist_id", "a.n AS attr_name", "a.v AS attr_value")


def boot_row(sp, sf):
    """The boot anchor as a table: the day before the first event."""
    return audit(sp, sf).agg(F.min("timestamp").alias("t")).select(F.lit(BOOT).cast("timestamp").alias("server_boot_time"))


STATEMENTS = """
se AS (SELECT event_id, event_id % (SELECT count(*) + count(*) // 10 FROM customer) AS thread_id, (epoch_us("timestamp") - epoch_us(TIMESTAMP '2023-12-31 00:00:00')) * 1000000 AS timer_start,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN concat(query, ' /* AUDITLOOM_EVENT */') ELSE query END AS sql_text,
 CASE WHEN event_id % 23 = 0 THEN 'audit_store' WHEN event_id % 5 = 0 THEN NULL ELSE "database" END AS current_schema, "timestamp",
 rows_returned AS rows_sent, rows_examined, rows_examined * 1000000007 AS timer_wait FROM audit),
th AS (SELECT c_custkey AS thread_id, c_custkey + 100000 AS processlist_id, CASE WHEN c_custkey % 29 = 0 THEN 'audit_monitor'
  WHEN c_custkey % 31 = 0 THEN NULL ELSE concat('user_', CAST(c_custkey % 8 AS VARCHAR)) END AS processlist_user,
  concat('10.1.0.', CAST(c_custkey % 250 AS VARCHAR), ':', CAST(30000 + c_custkey AS VARCHAR)) AS processlist_host
 FROM customer),
st AS (SELECT se.*, th.processlist_id, processlist_user, processlist_host,
  CASE WHEN th.processlist_id IS NOT NULL THEN concat('app_', CAST(se.thread_id % 3 AS VARCHAR)) END AS program_name,
  CASE WHEN th.processlist_id IS NOT NULL THEN 'Linux' END AS client_os,
  sha256(concat('2023-12-31 00:00:00.000000|', CAST(se.thread_id AS VARCHAR), '|', CAST(event_id AS VARCHAR), '|', CAST(timer_start AS VARCHAR))) AS fingerprint
 FROM se LEFT JOIN th ON th.thread_id = se.thread_id
 WHERE sql_text IS NOT NULL AND NOT contains(sql_text, 'AUDITLOOM_EVENT') AND (current_schema IS NULL OR current_schema <> 'audit_store')
  AND (processlist_user IS NULL OR processlist_user <> 'audit_monitor'))"""


def ingested(sp, sf):
    return ST.ingest_statements(statement_events(sp, sf), threads(sp, sf), session_attrs(sp, sf), boot_row(sp, sf))


def log_lines(sp, sf):
    """A text log made from the audit rows: sessions open, switch schema, run statements over one or two lines, close."""
    a = audit(sp, sf).withColumn("thread", (F.col("event_id") % 300).cast("string")).withColumn(
        "n", F.floor(F.col("event_id") / 300).cast("int"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(stamp, F.lit("\t"), F.col("thread"), F.lit(" "))
    line = F.array(
        F.when(F.col("n") % 6 == 0, F.concat(head, F.lit("Connect\t"), "user", F.lit("@"), "client_ip", F.lit(" on "),
                                             F.when(F.col("event_id") % 2 == 0, F.concat("database", F.lit(" "))).otherwise(""), F.lit("using TCP/IP"))),
        F.when(F.col("n") % 6 == 2, F.concat(head, F.lit("Init DB\tshop_"), F.col("thread"))),
        F.when(F.col("n") % 6 == 3, F.concat(head, F.lit("Query\tUSE `crm`"))),
        F.concat(head, F.lit("Query\t"), F.col("query")),
        F.when(F.col("event_id") % 5 == 0, F.lit("  AND extra = 1")),
        F.when(F.col("event_id") % 5 == 0, F.lit("   ")),
        F.when(F.col("n") % 6 == 4, F.concat(head, F.lit("Quit\t"))))
    us = F.unix_micros("timestamp")
    return (a.select((F.concat(F.lit("server_"), (F.col("event_id") % 3).cast("string"))).alias("file"),
                     (us - F.pmod(us, F.lit(86_400_000_000))).alias("block"), us.alias("us"), F.posexplode(line).alias("i", "value"))
            .where("value is not null").select("file", "block", (F.col("us") * 10 + F.col("i")).alias("pos"), "value"))


def _sources(cat: Catalog) -> None:
    cat.add("s01_statement_ingest", lambda sp, sf: ingested(sp, sf).select(
        "event_id", "event_ts", "processlist_user", "processlist_host", "program_name", "client_os", "current_schema"),
        S.sql("audit", 'SELECT event_id, "timestamp" AS event_ts, processlist_user, processlist_host, program_name, client_os, current_schema FROM st', STATEMENTS),
        ts=("event_ts",))
    cat.add("s01_statements_to_audit", lambda sp, sf: conform(ST.to_audit(ingested(sp, sf))).select(
        "event_id", "user", "client_ip", "database", "execution_time_ms", "scan_efficiency", "source_host"),
        S.sql("audit", """SELECT event_id, coalesce(processlist_user, 'unknown') AS "user",
         coalesce(split_part(processlist_host, ':', 1), 'unknown') AS client_ip, coalesce(lower(current_schema),
          lower(nullif(regexp_extract(sql_text, '(?i)(?:FROM|JOIN|UPDATE|INTO|TABLE|REPLACE\\s+INTO)\\s+([a-zA-Z0-9_]+)\\s*\\.\\s*[a-zA-Z0-9_]+', 1), '')), 'unknown') AS "database",
         timer_wait / 1e9::DOUBLE AS execution_time_ms, rows_sent / CAST(rows_examined + 1 AS DOUBLE) AS scan_efficiency, 'unknown' AS source_host FROM st""", STATEMENTS),
        rnd={"execution_time_ms": 6, "scan_efficiency": 6})
    cat.add("s02_session_attrs", lambda sp, sf: ST.pivot_session_attrs(session_attrs(sp, sf)),
            """SELECT c_custkey + 100000 AS processlist_id, concat('app_', CAST(c_custkey % 3 AS VARCHAR)) AS program_name,
             CAST(NULL AS VARCHAR) AS connector_name, 'Linux' AS client_os, CAST(NULL AS VARCHAR) AS source_host FROM customer""")
    cat.add("s03_event_time", lambda sp, sf: statement_events(sp, sf).select(
        "event_id", ST.event_time(F.lit(BOOT).cast("timestamp"), F.col("timer_start")).alias("event_ts")),
        S.sql("audit", 'SELECT event_id, "timestamp" AS event_ts FROM audit'), ts=("event_ts",))

    def snapshots(sp, sf):
        """Uptime of three servers sampled at each event; each restarts about every four days."""
        us = F.unix_micros("timestamp")
        up = F.pmod(F.floor(us / 1_000_000) + F.pmod("event_id", F.lit(3)) * 50_000, F.lit(345_600))
        return audit(sp, sf).select((F.col("event_id") % 3).alias("server"), F.col("timestamp").alias("snapshot_ts"),
                                    up.cast("long").alias("uptime_sec"))
    cat.add("s04_boot_anchors", lambda sp, sf: ST.boot_anchors(snapshots(sp, sf)),
            S.sql("audit", """SELECT server, "timestamp" AS snapshot_ts, up AS uptime_sec, r AS restart,
             last_value(CASE WHEN r THEN make_timestamp(implied) END IGNORE NULLS) OVER w AS boot_anchor FROM (
             SELECT *, coalesce(up < lag(up) OVER w OR abs(implied - lag(implied) OVER w) > 60000000, true) AS r FROM (
              SELECT *, epoch_us("timestamp") - up * 1000000 AS implied FROM (SELECT "timestamp", event_id % 3 AS server,
               CAST((epoch_us("timestamp") // 1000000 + (event_id % 3) * 50000) % 345600 AS BIGINT) AS up FROM audit)) 
             WINDOW w AS (PARTITION BY server ORDER BY "timestamp")) WINDOW w AS (PARTITION BY server ORDER BY "timestamp")"""),
            ts=("snapshot_ts", "boot_anchor"))
    cat.add("s05_fingerprint", lambda sp, sf: ingested(sp, sf).select("event_id", "fingerprint"),
            S.sql("audit", "SELECT event_id, fingerprint FROM st", STATEMENTS))

    def twice(sp, sf):
        new = ingested(sp, sf)
        again = new.where("event_id % 3 = 0")
        return ST.dedup_statements(new.unionByName(again), new.where("event_id % 4 = 0"))
    cat.add("s06_dedup_statements", lambda sp, sf: twice(sp, sf).select("event_id", "fingerprint"),
            S.sql("audit", "SELECT event_id, fingerprint FROM st WHERE event_id % 4 <> 0", STATEMENTS))
    cat.add("s07_incremental_overlap", lambda sp, sf: ST.incremental(ingested(sp, sf), "2024-01-20 00:00:05").select("event_id", "event_ts"),
            S.sql("audit", """SELECT event_id, "timestamp" AS event_ts FROM st WHERE "timestamp" > TIMESTAMP '2024-01-19 23:59:55'""", STATEMENTS),
            ts=("event_ts",))
    def by_hour(sp, sf):
        return audit(sp, sf).withColumn("hour", F.date_trunc("hour", "timestamp"))
    cat.add("s08_incremental_page", lambda sp, sf: ST.incremental_by(
        by_hour(sp, sf), {"hour": F.lit("2024-01-03 04:00:00").cast("timestamp"), "event_id": 100}).select("event_id", "query"),
            S.sql("audit", """SELECT event_id, query FROM audit WHERE date_trunc('hour', "timestamp") > TIMESTAMP '2024-01-03 04:00:00'
             OR (date_trunc('hour', "timestamp") = TIMESTAMP '2024-01-03 04:00:00' AND event_id > 100)"""))

    def hot_cold(sp, sf):
        rows = ingested(sp, sf)
        return ST.merge_hot_cold(rows.where("event_ts >= '2024-01-10'"), rows.where("event_ts < '2024-01-20'").drop("processlist_id"))
    cat.add("s09_merge_hot_cold", lambda sp, sf: hot_cold(sp, sf).select("event_id", "fingerprint"),
            S.sql("audit", "SELECT event_id, fingerprint FROM st", STATEMENTS))

    def log_table(sp, sf):
        return audit(sp, sf).select(
            F.col("timestamp").alias("event_time"),
            F.expr("CASE WHEN event_id % 13 = 0 THEN 'audit_monitor[x] @ h []' ELSE concat(user, '[', user, '] @ host [', CASE WHEN event_id % 7 = 0 THEN '' ELSE client_ip END, ']') END").alias("user_host"),
            F.expr("CASE WHEN event_id % 5 = 0 THEN 'Connect' ELSE 'Query' END").alias("command_type"), F.col("query").alias("argument"))
    cat.add("s10_general_log_table", lambda sp, sf: general_log.read_general_log_table(log_table(sp, sf)),
            S.sql("audit", """SELECT "timestamp", "user", "user" AS client_ip, 'N/A' AS "database", query FROM audit WHERE event_id % 13 <> 0 AND event_id % 5 <> 0"""),
            ts=("timestamp",))

    cat.add("s11_general_log_text", lambda sp, sf: general_log.parse_general_log(log_lines(sp, sf), filter_user="user_7").select(
        "timestamp", "user", "client_ip", "database", "query", "thread"),
        S.sql("audit", """SELECT "timestamp", su AS "user", sip AS client_ip, db AS "database", q AS query, thread FROM (
         SELECT *, CASE WHEN kind = 'q' THEN qtext END AS q,
          last_value(CASE WHEN kind = 'connect' THEN "user" WHEN kind = 'quit' THEN '' END IGNORE NULLS) OVER w AS su,
          last_value(CASE WHEN kind = 'connect' THEN client_ip WHEN kind = 'quit' THEN '' END IGNORE NULLS) OVER w AS sip,
          last_value(CASE WHEN kind = 'connect' THEN CASE WHEN event_id % 2 = 0 THEN "database" ELSE 'N/A' END WHEN kind = 'init' THEN 'shop_' || thread
            WHEN kind = 'use' THEN 'crm' END IGNORE NULLS) OVER w AS db FROM ln WINDOW w AS (PARTITION BY thread ORDER BY "timestamp", ord))
         WHERE kind IN ('q', 'use') AND su <> ''""",
         """b AS (SELECT *, CAST(event_id % 300 AS VARCHAR) AS thread, event_id // 300 AS n FROM audit),
         ln AS (SELECT *, 1 AS ord, 'connect' AS kind, '' AS qtext FROM b WHERE n % 6 = 0 AND "user" <> 'user_7'
          UNION ALL SELECT *, 2, 'init', '' FROM b WHERE n % 6 = 2 UNION ALL SELECT *, 3, 'use', 'USE `crm`' FROM b WHERE n % 6 = 3
          UNION ALL SELECT *, 4, 'q', query || CASE WHEN event_id % 5 = 0 THEN chr(10) || '  AND extra = 1' ELSE '' END FROM b
          UNION ALL SELECT *, 5, 'quit', '' FROM b WHERE n % 6 = 4)""").replace(
             "CASE WHEN kind = 'q' THEN qtext END AS q", "qtext AS q"), ts=("timestamp",))

    def csvlog(sp, sf):
        """Records written as csvlog files and read back; every ninth statement spans two lines."""
        path = fresh(sp, "csvlog")
        empty = [F.lit("x").alias(c) for c in files.CSVLOG_COLUMNS[5:13]]
        audit(sp, sf).select(
            F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")).alias("log_time"), F.col("user").alias("user_name"),
            F.col("database").alias("database_name"), F.lit("1").alias("process_id"),
            F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat(client_ip, ':5432') END").alias("connection_from"), *empty,
            F.expr("CASE WHEN event_id % 4 = 0 THEN 'duration: 3 ms' WHEN event_id % 9 = 0 THEN concat('statement: ', query, '\n  LIMIT 5') ELSE concat('statement: ', query) END").alias("message")
        ).write.csv(path, quoteAll=True, escape='"')
        return files.read_pg_csvlog(sp, path)
    cat.add("s12_pg_csvlog", csvlog, S.sql("audit", """SELECT "timestamp", "user", CASE WHEN event_id % 6 = 0 THEN 'N/A' ELSE client_ip END AS client_ip, "database",
        CASE WHEN event_id % 9 = 0 THEN query || chr(10) || '  LIMIT 5' ELSE query END AS query FROM audit WHERE event_id % 4 <> 0"""), ts=("timestamp",))

    def messages(sp, sf):
        body = F.to_json(F.struct("event_id", "query", "user", F.expr("CASE WHEN k % 4 <> 0 THEN rows_returned END").alias("rows_returned"),
                                  F.expr("CASE WHEN event_id % 10 = 0 THEN 'never' ELSE date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END").alias("timestamp")))
        return files.parse_messages(audit(sp, sf).select(body.alias("value")))
    cat.add("s14_json_messages", lambda sp, sf: messages(sp, sf).select("event_id", "timestamp", "user", "query", "rows_returned", "database"),
            S.sql("audit", """SELECT event_id, "timestamp", "user", query, CASE WHEN k % 4 <> 0 THEN rows_returned ELSE 0 END AS rows_returned,
             'unknown' AS "database" FROM audit WHERE event_id % 10 <> 0"""), ts=("timestamp",))

    def staging(sp, sf):
        path = fresh(sp, "staging")
        a = audit(sp, sf).select("event_id", "user", "query", F.expr("CASE WHEN event_id % 8 = 0 THEN 'bad' ELSE date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END").alias("timestamp"))
        K.write_staging(a.where("event_id % 2 = 0"), path)
        K.write_staging(a.where("event_id % 2 = 1").withColumn("rows_returned", F.lit(7).cast("long")), path)
        return files.read_staging(sp, path)
    cat.add("s15_staging_scan", lambda sp, sf: staging(sp, sf).select("event_id", "timestamp", "user", "rows_returned"),
            S.sql("audit", """SELECT event_id, "timestamp", "user", CAST(CASE WHEN event_id % 2 = 1 THEN 7 ELSE 0 END AS BIGINT) AS rows_returned
             FROM audit WHERE event_id % 8 <> 0"""), ts=("timestamp",))

    def labelled(sp, sf):
        from pyspark.sql import types as T
        path = fresh(sp, "labelled")
        a = audit(sp, sf).select("event_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "user", "query",
                                 F.expr("CASE WHEN k % 7 = 0 THEN 'ATTACK' ELSE 'NORMAL' END").alias("behavior_type"), F.expr("CAST(k % 7 = 0 AS INT)").alias("is_anomaly"))
        a.write.csv(path, header=True, quoteAll=True, escape='"')
        return files.read_labelled_csv(sp, path, T.StructType([
            T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("user", T.StringType()),
            T.StructField("query", T.StringType()), T.StructField("behavior_type", T.StringType()), T.StructField("is_anomaly", T.IntegerType())]))
    cat.add("s16_labelled_csv", lambda sp, sf: labelled(sp, sf).select("event_id", "timestamp", "query", "behavior_type", "is_anomaly"),
            S.sql("audit", """SELECT event_id, "timestamp", query, CASE WHEN k % 7 = 0 THEN 'ATTACK' ELSE 'NORMAL' END AS behavior_type,
             CAST(k % 7 = 0 AS INTEGER) AS is_anomaly FROM audit"""), ts=("timestamp",))
    cat.add("s17_audit_trail", lambda sp, sf: files.trail_entries(trail_lines(sp, sf)).orderBy(F.desc("timestamp"), F.desc("entry_id")).limit(50).select(
        "entry_id", "timestamp", "event_type", "user_account", "risk_score"),
        S.sql("audit", TRAIL_SQL + " ORDER BY timestamp DESC, entry_id DESC LIMIT 50"), rnd={"risk_score": 6})

    def actions(sp, sf):
        text = F.expr("""CASE WHEN event_id % 5 = 0 THEN concat('noise ', event_id) ELSE concat(date_format(timestamp, 'yyyy-MM-dd HH:mm:ss'),
         ',', date_format(timestamp, 'SSS'), ' - ACTION: LOCK_ACCOUNT | TARGET: ', user, '@', client_ip, ' | REASON: Count: ', k) END""")
        return audit(sp, sf).select("event_id", text.alias("value"))
    cat.add("s18_action_log", lambda sp, sf: files.action_entries(actions(sp, sf)).orderBy(F.desc("event_id")).limit(100),
            S.sql("audit", """SELECT event_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ',' || strftime("timestamp", '%g') AS "timestamp", 'LOCK_ACCOUNT' AS action,
             "user" || '@' || client_ip AS target, 'Count: ' || CAST(k AS VARCHAR) AS reason FROM audit WHERE event_id % 5 <> 0 ORDER BY event_id DESC LIMIT 100"""))
    cat.add("s19_geo_lookup", lambda sp, sf: geo.locate(audit(sp, sf), X.geo_ranges(sp, sf)).select("event_id", "client_ip", "lat", "lon"),
            S.sql("geo", "SELECT a.event_id, a.client_ip, l.lat, l.lon FROM audit a LEFT JOIN located l ON l.event_id = a.event_id"))


def trail_lines(sp, sf):
    """Audit trail lines: a header, entries and some broken lines."""
    body = F.to_json(F.struct(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("entry_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.expr("CASE WHEN event_id % 50 = 0 THEN 'threat_detection' ELSE 'query_seen' END").alias("event_type"), F.col("user").alias("user_account"),
        F.expr("(k % 100) / 100.0D").alias("risk_score"), F.col("client_ip").alias("source_ip")))
    line = (F.when(F.col("event_id") % 41 == 0, F.lit('{"log_type": "audit", "version": "1.0.0"}'))
            .when(F.col("event_id") % 43 == 0, F.concat(F.lit("{broken "), body)).otherwise(body))
    return audit(sp, sf).select("event_id", line.alias("value"))


TRAIL_SQL = """SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS entry_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
 CASE WHEN event_id % 50 = 0 THEN 'threat_detection' ELSE 'query_seen' END AS event_type, "user" AS user_account,
 CAST((k % 100) / 100.0 AS DOUBLE) AS risk_score FROM audit WHERE event_id % 41 <> 0 AND event_id % 43 <> 0"""


# --- sinks -----------------------------------------------------------------------------------------------------------
def events_table(sp, sf):
    """Stored event anomalies; the id is the row and set it came from."""
    sets = {g: i for i, g in enumerate(D.SET_NAMES)}
    rank = F.create_map(*[x for g, i in sets.items() for x in (F.lit(g), F.lit(i))])
    return stored(sp, sf).anomalies.withColumn("id", F.col("event_id") * 10 + rank[F.col("behavior_group")])


def aggregates_table(sp, sf):
    s = D.session_anomalies(stored(sp, sf).sessions)
    return s.withColumns({"id": F.unix_micros("session_start") + F.substring("user", 6, 9).cast("long"),
                          "created_at": F.col("end_time") + F.expr("INTERVAL 1 MINUTE")})


RANK = "CASE behavior_group " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(D.SET_NAMES)) + " END"
STORED = f"""evt AS (SELECT *, event_id * 10 + {RANK} AS id FROM anomalies),
agg AS (SELECT epoch_us(session_start) + CAST(substr("user", 6) AS BIGINT) AS id, 'session' AS scope, "user", client_ip, CAST(NULL AS VARCHAR) AS "database",
 start_time, end_time, 'multi_table_access' AS anomaly_type, CAST(n_tables AS DOUBLE) AS severity, 'Accessed ' || CAST(n_tables AS VARCHAR) || ' tables in short window' AS reason,
 tables, query_count, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS duration_sec, end_time + INTERVAL 1 MINUTE AS created_at FROM sessions)"""


def _sinks(cat: Catalog) -> None:
    def k01(sp, sf):
        path = fresh(sp, "all_logs")
        logs = stored(sp, sf).logs
        K.write_daily(K.stored_logs(FE.rolling_5m(FE.static_features(logs))), path)
        return sp.read.parquet(path)
    cat.add("k01_all_logs", lambda sp, sf: k01(sp, sf).select(
        "event_id", "timestamp", "user", "is_anomaly", "is_system_table", "has_error", "rows_returned", "query_count_5m", "execution_time_ms",
        "behavior_group", "num_joins", F.col("event_date").cast("string").alias("event_date")),
        S.sql("det", """SELECT event_id, "timestamp", "user", (reason IS NOT NULL OR hour("timestamp") < 6 OR regexp_matches(query, '^(INSERT|UPDATE|DELETE|CREATE USER)') OR error_code <> 0) AS is_anomaly,
         is_system_table = 1 AS is_system_table, error_code <> 0 AS has_error, rows_returned,
         CAST(count(*) OVER (PARTITION BY "user" ORDER BY epoch_us("timestamp") RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS query_count_5m,
         execution_time_ms, behavior_group, CAST(len(regexp_extract_all(query, '\\bJOIN\\b')) AS BIGINT) AS num_joins, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date FROM final"""),
        ts=("timestamp",), rnd={"execution_time_ms": 4})
    cat.add("k02_event_anomalies", lambda sp, sf: stored(sp, sf).anomalies.select(
        "event_id", "timestamp", "user", "anomaly_type", "behavior_group", "score", "reason", "status", "execution_time_ms", "rows_returned", "rows_affected"),
        S.sql("anomalies", """SELECT event_id, "timestamp", "user", anomaly_type, behavior_group, score, reason, status, execution_time_ms, rows_returned, rows_affected FROM anomalies"""),
        ts=("timestamp",), rnd={"execution_time_ms": 4})
    cat.add("k03_session_anomalies", lambda sp, sf: aggregates_table(sp, sf).select(
        "id", "scope", "user", "client_ip", "start_time", "anomaly_type", "severity", "reason", F.col("details.tables").alias("tables"),
        F.col("details.query_count").alias("query_count"), F.col("details.duration_sec").alias("duration_sec")),
        S.sql("all", 'SELECT id, scope, "user", client_ip, start_time, anomaly_type, severity, reason, tables, query_count, duration_sec FROM agg', STORED),
        ts=("start_time",), arr=("tables",), rnd={"duration_sec": 6})

    def k04(sp, sf):
        path = fresh(sp, "raw")
        K.write_staging(audit(sp, sf).select("event_id", "timestamp", "query"), path)
        K.write_staging(audit(sp, sf).where("event_id % 10 = 0").select("event_id", "timestamp", "query"), path)
        return sp.read.parquet(path)
    cat.add("k04_raw_staging", lambda sp, sf: k04(sp, sf).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")),
            S.sql("audit", "SELECT event_id, CAST(CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM audit"))

    def feedback(sp, sf):
        a = audit(sp, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        old = K.feedback_rows(a.where("event_id % 2 = 0").select("timestamp", "user", "query", "client_ip", F.lit(0).cast("long").alias("arrival")), F.lit(0))
        new = K.feedback_rows(a.where("event_id % 3 = 0").select("timestamp", "user", "query", F.lit("checked").alias("note"), F.col("event_id").alias("arrival")), F.lit(1))
        later = K.feedback_rows(a.where("event_id % 9 = 0").select("timestamp", "user", "query", F.lit("again").alias("note"), (F.col("event_id") + 1).alias("arrival")), F.lit(2))
        return K.upsert_feedback(old, new.unionByName(later))
    cat.add("k05_feedback_upsert", lambda sp, sf: feedback(sp, sf).drop("arrival"),
            S.sql("audit", """SELECT md5(strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') || "user" || query) AS feedback_id,
             CASE WHEN event_id % 9 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_anomaly_label, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
             "user", query, CASE WHEN event_id % 2 = 0 THEN client_ip END AS client_ip, CASE WHEN event_id % 9 = 0 THEN 'again' WHEN event_id % 3 = 0 THEN 'checked' END AS note
             FROM audit WHERE event_id % 2 = 0 OR event_id % 3 = 0"""))

    def daily(sp, sf):
        path = fresh(sp, "daily")
        K.write_daily(audit(sp, sf).select("event_id", "user", "timestamp", F.to_date("timestamp").alias("event_date")), path)
        return sp.read.parquet(path)
    cat.add("k06_retention", lambda sp, sf: K.live_days(daily(sp, sf), F.lit("2024-02-14").cast("date")).select("event_id", "user"),
            S.sql("audit", """SELECT event_id, "user" FROM audit WHERE "timestamp" >= TIMESTAMP '2024-01-15 00:00:00'"""))
    cat.add("k06_expired_days", lambda sp, sf: K.expired_days(daily(sp, sf), F.lit("2024-02-14").cast("date")).select(F.col("event_date").cast("string").alias("event_date")),
            S.sql("audit", """SELECT DISTINCT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date FROM audit WHERE "timestamp" < TIMESTAMP '2024-01-15 00:00:00'"""))
    cat.add("k07_ingest_metrics", lambda sp, sf: K.ingest_metrics(audit(sp, sf).withColumn("run", F.floor(F.col("event_id") / 5000)), ("run",), "timestamp", "timestamp"),
            S.sql("audit", """SELECT event_id // 5000 AS run, count(*) AS rows_inserted, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000.0::DOUBLE AS duration_ms FROM audit GROUP BY 1"""),
            rnd={"duration_ms": 3})

    def observed(sp, sf):
        """Three real writes, with what each counted itself."""
        path = fresh(sp, "metered")
        rows = audit(sp, sf)
        runs = [K.metered(rows.where(F.col("event_id") % 3 == k), lambda d, k=k: d.write.parquet(f"{path}/{k}"), f"run_{k}") for k in range(3)]
        return sp.createDataFrame([tuple(r.values()) for r in runs], K.METERED)
    cat.add("k07_observed_writes", lambda sp, sf: observed(sp, sf).select("run", "rows_inserted", (F.col("duration_ms") > 0).alias("timed"), "error"),
            S.sql("audit", "SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, count(*) AS rows_inserted, true AS timed, CAST(NULL AS VARCHAR) AS error FROM audit GROUP BY 1"))

    def payload(sp, sf):
        logs = stored(sp, sf).logs.where("is_anomaly").withColumns({
            "command_type": F.lit("X"), "is_late_night": F.hour("timestamp") < 6, "error_count_5m": F.lit(0)})
        return logs.select("event_id", K.evidence_payload(F.col("specific_rule")).alias("payload"))
    cat.add("k08_evidence_payload", lambda sp, sf: payload(sp, sf).select(
        "event_id", *[F.get_json_object("payload", p).alias(n) for n, p in (
            ("who", "$.identity.user"), ("ip", "$.identity.ip"), ("night", "$.timing.is_late_night"), ("sql", "$.query_content.sql"),
            ("rows", "$.performance_metrics.rows_examined"), ("flag", "$.system_detection.initial_flag"))]),
        S.sql("det", """SELECT event_id, "user" AS who, client_ip AS ip, CAST(hour("timestamp") < 6 AS VARCHAR) AS night, query AS sql,
         CAST(rows_examined AS VARCHAR) AS rows, reason AS flag FROM final WHERE reason IS NOT NULL"""))

    def export(sp, sf):
        path = fresh(sp, "dashboard")
        Q.top_risky_users(events_table(sp, sf), 1000).write.json(path)
        return sp.read.schema("user string, total_score double, violation_count bigint").json(path)
    cat.add("k09_dashboard_export", export, S.sql("all", 'SELECT "user", sum(score) AS total_score, count(*) AS violation_count FROM evt GROUP BY "user"', STORED),
            rnd={"total_score": 4})


# --- read-outs -------------------------------------------------------------------------------------------------------
def _readouts(cat: Catalog) -> None:
    ev, ag = events_table, aggregates_table

    def add(name, fn, body, **kw):
        cat.add(name, fn, S.sql("all", body, STORED), **kw)
    flt = dict(user="user_2", date_from="2024-01-05", date_to="2024-01-20")
    add("q01_common_filters", lambda sp, sf: Q.filter_events(ev(sp, sf), anomaly_type="SQL Injection", **flt).select("id", "reason"),
        """SELECT id, reason FROM evt WHERE "user" = 'user_2' AND anomaly_type = 'SQL Injection' AND "timestamp" >= '2024-01-05' AND "timestamp" <= '2024-01-20'""")
    add("q01_aggregate_filters", lambda sp, sf: Q.filter_aggregates(ag(sp, sf), **flt).select("id", "reason"),
        """SELECT id, reason FROM agg WHERE "user" = 'user_2' AND (start_time >= '2024-01-05' OR created_at >= '2024-01-05')
         AND (end_time <= '2024-01-20' OR created_at <= '2024-01-20')""")
    add("q02_totals", lambda sp, sf: Q.totals(stored(sp, sf).logs, ev(sp, sf), ag(sp, sf)),
        """SELECT (SELECT count(*) FROM audit) AS total_scanned, (SELECT count(*) FROM evt) + (SELECT count(*) FROM agg) AS total_anomalies,
         (SELECT count(*) FROM evt WHERE behavior_group IN ('TECHNICAL_ATTACK', 'DATA_DESTRUCTION')) AS critical_alerts""")
    spans = {"D": ("24 HOUR", "hour", "INTERVAL 23 HOUR"), "W": ("7 DAY", "day", None), "M": ("30 DAY", "day", None),
             "6M": ("180 DAY", "month", None), "Y": ("365 DAY", "month", None)}
    for code, (span, step, first) in spans.items():
        add(f"q03_time_series_{code.lower()}", lambda sp, sf, code=code: Q.time_series(ev(sp, sf), ag(sp, sf), F.lit(NOW).cast("timestamp"), code),
            f"""SELECT b AS bucket, coalesce(n, 0) AS anomalies FROM (SELECT unnest(generate_series(date_trunc('{step}', TIMESTAMP '{NOW}' - {first or 'INTERVAL ' + span}),
             date_trunc('{step}', TIMESTAMP '{NOW}'), INTERVAL 1 {step})) AS b) s LEFT JOIN (SELECT date_trunc('{step}', t) AS d, count(*) AS n FROM (
             SELECT "timestamp" AS t FROM evt UNION ALL SELECT created_at FROM agg) WHERE t >= TIMESTAMP '{NOW}' - INTERVAL {span} AND t <= TIMESTAMP '{NOW}' GROUP BY 1) c ON c.d = s.b""",
            ts=("bucket",))
    add("q04_top_risky_users", lambda sp, sf: Q.top_risky_users(ev(sp, sf)),
        'SELECT "user", sum(score) AS total_score, count(*) AS violation_count FROM evt GROUP BY "user" ORDER BY total_score DESC, "user" LIMIT 10', rnd={"total_score": 4})
    labels = " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in Q.GROUP_LABELS.items())
    add("q05_group_distribution", lambda sp, sf: Q.group_distribution(ev(sp, sf), ag(sp, sf)),
        f"""SELECT name, CAST(sum(value) AS BIGINT) AS value FROM (SELECT CASE behavior_group {labels} ELSE 'Other' END AS name, count(*) AS value FROM evt GROUP BY 1
         UNION ALL SELECT 'Mass/Multi-Table', count(*) FROM agg) WHERE value > 0 GROUP BY name""")
    add("q06_top_databases", lambda sp, sf: Q.top_databases(ev(sp, sf)),
        'SELECT "database" AS name, count(*) AS value FROM evt GROUP BY 1 ORDER BY value DESC, name LIMIT 5')
    add("q07_latest_events", lambda sp, sf: Q.latest_events(ev(sp, sf)).select("id", "timestamp", "user", "anomaly_type", "score", "query", "reason"),
        'SELECT id, "timestamp", "user", anomaly_type, score, query, reason FROM evt ORDER BY "timestamp" DESC, id DESC LIMIT 10', ts=("timestamp",))
    add("q08_kpis", lambda sp, sf: Q.kpis(ev(sp, sf), ag(sp, sf)),
        "SELECT " + ", ".join(f"count_if(behavior_group = '{g}')::BIGINT AS {n}" for g, n in (
            ("ACCESS_ANOMALY", "access_anomaly"), ("INSIDER_THREAT", "insider_threat"), ("TECHNICAL_ATTACK", "technical_attack"),
            ("DATA_DESTRUCTION", "data_destruction"), ("ML_DETECTED", "ml_detected"), ("UNUSUAL_BEHAVIOR", "behavioral_profile")))
        + ", (SELECT count(*) FROM agg) AS multi_table, count(*) + (SELECT count(*) FROM agg) AS total FROM evt")
    add("q09_facets", lambda sp, sf: Q.facets(ev(sp, sf), ag(sp, sf)),
        """SELECT 'user' AS facet, "user" AS value FROM evt UNION SELECT 'user', "user" FROM agg UNION SELECT 'type', anomaly_type FROM evt UNION SELECT 'type', anomaly_type FROM agg""")
    add("q09_facets_of_group", lambda sp, sf: Q.facets(ev(sp, sf), ag(sp, sf), "DATA_DESTRUCTION"),
        """SELECT 'user' AS facet, "user" AS value FROM evt WHERE behavior_group = 'DATA_DESTRUCTION' UNION SELECT 'type', anomaly_type FROM evt WHERE behavior_group = 'DATA_DESTRUCTION'""")
    uni = """u AS (SELECT 'event-' || CAST(id AS VARCHAR) AS id, 'event' AS source, anomaly_type, behavior_group, "timestamp" AS t, "user", reason, score, query FROM evt
      UNION ALL SELECT 'agg-' || CAST(id AS VARCHAR), 'aggregate', anomaly_type, 'MULTI_TABLE_ACCESS', coalesce(start_time, end_time, created_at), "user", reason, severity, NULL FROM agg)"""
    cols = "id, source, anomaly_type, behavior_group, t AS timestamp, \"user\", reason, score"
    take = ("id", "source", "anomaly_type", "behavior_group", "timestamp", "user", "reason", "score")

    def addu(name, fn, body, **kw):
        cat.add(name, fn, S.sql("all", body, STORED, uni), **kw)
    addu("q10_search", lambda sp, sf: Q.search(ev(sp, sf), ag(sp, sf), 40, 20, search="Detected", user="user_3").select(*take),
         f"""SELECT {cols} FROM u WHERE "user" = 'user_3' AND (query ILIKE '%detected%' OR reason ILIKE '%detected%') ORDER BY t DESC, id DESC OFFSET 40 LIMIT 20""", ts=("timestamp",))
    addu("q10_search_sessions", lambda sp, sf: Q.search(ev(sp, sf), ag(sp, sf), 0, 20, search="SALARIES", behavior_group="MULTI_TABLE_ACCESS").select(*take),
         f"""SELECT {cols} FROM u JOIN (SELECT 'agg-' || CAST(id AS VARCHAR) AS aid, tables FROM agg) g ON g.aid = u.id
          WHERE array_to_string(tables, ',') ILIKE '%salaries%' ORDER BY t DESC, id DESC LIMIT 20""", ts=("timestamp",))
    addu("q10_search_total", lambda sp, sf: Q.search_total(ev(sp, sf), ag(sp, sf), search="union"),
         "SELECT count(*) AS total FROM u WHERE query ILIKE '%union%' OR reason ILIKE '%union%'")
    add("q11_event_list", lambda sp, sf: Q.page(Q.filter_events(ev(sp, sf), search="salaries"), 100, 100).select("id", "timestamp", "query", "reason"),
        """SELECT id, "timestamp", query, reason FROM evt WHERE query ILIKE '%salaries%' OR reason ILIKE '%salaries%' ORDER BY "timestamp" DESC, id DESC OFFSET 100 LIMIT 100""", ts=("timestamp",))
    add("q11_aggregate_list", lambda sp, sf: Q.aggregate_page(ag(sp, sf), 5, 50).select("id", "start_time", "user", "severity"),
        'SELECT id, start_time, "user", severity FROM agg ORDER BY start_time DESC NULLS LAST, created_at DESC, id DESC OFFSET 5 LIMIT 50', ts=("start_time",))
    addu("q12_unified_list", lambda sp, sf: Q.page(Q.unified(ev(sp, sf), ag(sp, sf)), 200, 100).select(*take),
         f"SELECT {cols} FROM u ORDER BY t DESC NULLS LAST, id DESC OFFSET 200 LIMIT 100", ts=("timestamp",))
    add("q13_point_lookup", lambda sp, sf: Q.by_id(ev(sp, sf), F.lit(1232)).select("id", "user", "anomaly_type", "query"),
        'SELECT id, "user", anomaly_type, query FROM evt WHERE id = 1232')
    cat.add("q14_log_explorer", lambda sp, sf: Q.explore_logs(stored(sp, sf).logs, search="join", user="user_1", date_from="2024-01-03", date_to="2024-01-25",
            behavior_group="TECHNICAL_ATTACK", skip=10, limit=100).select("event_id", "timestamp", "query"),
            S.sql("det", """SELECT event_id, "timestamp", query FROM final WHERE query ILIKE '%join%' AND "user" = 'user_1' AND behavior_group = 'TECHNICAL_ATTACK'
             AND "timestamp" >= '2024-01-03' AND "timestamp" <= '2024-01-25' ORDER BY "timestamp" DESC, event_id DESC OFFSET 10 LIMIT 100"""), ts=("timestamp",))
    cat.add("q15_anomalies_only", lambda sp, sf: Q.anomalies_only(stored(sp, sf).logs).select("event_id", "unusual_activity_reason"),
            S.sql("det", "SELECT event_id, reason AS unusual_activity_reason FROM final WHERE reason IS NOT NULL"))
    cat.add("q16_trail_alerts", lambda sp, sf: Q.trail_alerts(files.trail_entries(trail_lines(sp, sf))).select(
        "id", "timestamp", "severity", "title", "description", "component", "risk_score", "status", "affected_users"),
        S.sql("audit", f"""SELECT entry_id AS id, timestamp, CASE WHEN risk_score >= 0.9 THEN 'critical' ELSE 'high' END AS severity,
         CASE event_type WHEN 'query_seen' THEN 'Query Seen' ELSE 'Threat Detection' END AS title, '{{}}' AS description, 'unknown' AS component, risk_score, 'new' AS status,
         user_account AS affected_users FROM ({TRAIL_SQL}) WHERE risk_score >= 0.7 OR event_type = 'threat_detection' ORDER BY timestamp DESC, entry_id DESC LIMIT 20"""),
        rnd={"risk_score": 6})
    cat.add("q17_recent_line_counts", lambda sp, sf: Q.recent_line_counts(audit(sp, sf).select("event_id", F.expr(
        "concat(CASE k % 3 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'WARNING ' ELSE 'INFO ' END, query)").alias("value")), "event_id"),
        S.sql("audit", """SELECT count(*) AS n_lines, count_if(k % 3 = 0)::BIGINT AS errors, count_if(k % 3 = 1)::BIGINT AS warnings
         FROM (SELECT * FROM audit ORDER BY event_id DESC LIMIT 20)"""))
