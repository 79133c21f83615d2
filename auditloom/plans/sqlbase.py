"""Shared SQL for the side-by-side check: the audit adapter, the rule flags and what follows from them."""

from __future__ import annotations

ADAPTER = """
ev AS (
 SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events),
ad AS (
 SELECT event_id, ts AS "timestamp", k, value,
  concat('user_', CAST(user_id % 8 AS VARCHAR)) AS "user",
  concat('10.0.', CAST(k % 3 AS VARCHAR), '.', CAST(user_id % 5 AS VARCHAR)) AS client_ip,
  CASE WHEN event_type='view' THEN 'hr_db' WHEN event_type='error' THEN 'mysql' ELSE 'sales_db' END AS "database",
  CASE
   WHEN event_type='click' THEN concat('SELECT * FROM sales_db.orders o JOIN sales_db.customers c ON o.cid = c.id WHERE o.id = ', CAST(k AS VARCHAR))
   WHEN event_type='view' THEN concat('SELECT s.amount FROM hr_db.salaries s JOIN hr_db.employees e ON s.eid = e.id LIMIT ', CAST(k*100 AS VARCHAR))
   WHEN event_type='purchase' THEN concat('INSERT INTO sales_db.orders VALUES (', CAST(k AS VARCHAR), ', ''abc'')')
   WHEN event_type='signup' AND k < 10 THEN concat('CREATE USER ''ghost_', CAST(k AS VARCHAR), ''' IDENTIFIED BY ''x''')
   WHEN event_type='signup' AND k < 20 THEN 'RENAME TABLE sales_db.t1 TO sales_db.t2'
   WHEN event_type='signup' AND k < 30 THEN 'SELECT JSON_EXTRACT(doc, ''$.a'') FROM sales_db.docs /* probe */'
   WHEN event_type='signup' AND k < 40 THEN 'UPDATE sales_db.orders SET note = ''x'' WHERE fiscal_year = 2020'
   WHEN event_type='signup' THEN concat('UPDATE sales_db.customers SET name = ''n'' WHERE id = ', CAST(k AS VARCHAR))
   WHEN k % 4 = 0 THEN concat('SELECT * FROM users WHERE id = ', CAST(k AS VARCHAR), ' OR 1=1 -- x')
   WHEN k % 4 = 1 THEN 'SELECT name FROM products UNION SELECT authentication_string FROM mysql.user'
   WHEN k % 4 = 2 THEN concat('DELETE FROM app_db.audit_log WHERE id < ', CAST(k AS VARCHAR))
   ELSE 'SET GLOBAL general_log = OFF' END AS query,
  CAST(CASE WHEN event_type='error' AND k % 2 = 0 THEN 1045 ELSE 0 END AS BIGINT) AS error_code,
  value*100 AS execution_time_ms, value*12 AS cpu_time_ms, value*7 AS lock_time_ms,
  CASE WHEN k % 9 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(floor(value*10) AS BIGINT) END AS rows_returned,
  CAST(floor(value*200) AS BIGINT) AS rows_examined
 FROM ev),
audit AS (
SELECT ad.*,
 CASE WHEN query LIKE 'UPDATE sales_db.customers%' AND k % 5 = 0 THEN 'connect'
  WHEN query LIKE 'SELECT%' THEN 'statement/sql/select' WHEN query LIKE 'INSERT%' THEN 'statement/sql/insert'
  WHEN query LIKE 'UPDATE%' THEN 'statement/sql/update' WHEN query LIKE 'DELETE%' THEN 'statement/sql/delete'
  WHEN query LIKE 'CREATE USER%' THEN 'statement/sql/create_user'
  WHEN query LIKE 'RENAME%' THEN 'statement/sql/rename_table' ELSE 'statement/sql/set_option' END AS event_name,
 CASE WHEN query LIKE 'SELECT%' THEN CAST(0 AS BIGINT) ELSE CAST(floor(value*10) AS BIGINT) END AS rows_affected,
 CASE WHEN k % 2 = 0 THEN 'TCP/IP' ELSE 'Socket' END AS connection_type,
 CASE WHEN k = 7 THEN 'sqlmap' ELSE 'app' END AS program_name,
 CAST(k % 8 AS BIGINT) AS warning_count, CAST(k % 2 AS BIGINT) AS no_index_used, CAST(k % 3 AS BIGINT) AS select_full_join,
 CAST(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS created_tmp_disk_tables,
 CASE WHEN "database" IN ('mysql','sys','information_schema','performance_schema') THEN 1 ELSE 0 END AS is_system_table,
 CASE WHEN query LIKE '%--%' OR query LIKE '%/*%' OR query LIKE '%#%' THEN 1 ELSE 0 END AS has_comment
FROM ad)"""

OVERTIME = """
overtime AS (
 SELECT DISTINCT concat('user_', CAST(o_custkey % 8 AS VARCHAR)) AS "user",
  DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS "date",
  CASE WHEN o_orderkey % 2 = 0 THEN 79200 ELSE 3600 END AS s0,
  CASE WHEN o_orderkey % 2 = 0 THEN 1800 ELSE 9000 END AS s1,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('10.0.', CAST(o_custkey % 3 AS VARCHAR), '.', CAST(o_custkey % 5 AS VARCHAR)) END AS ip
 FROM orders)"""

GEO = """
geo AS (
 SELECT CAST(167772160 + n_nationkey * 256 AS BIGINT) AS start_num, CAST(167772160 + n_nationkey * 256 + 3 AS BIGINT) AS end_num,
  CAST(-60 + n_nationkey * 20 AS DOUBLE) AS lat, CAST(n_nationkey * 30 AS DOUBLE) AS lon FROM nation),
located AS (
 SELECT a.event_id, a."user", a.client_ip, a."timestamp", g.lat, g.lon FROM audit a JOIN geo g ON
  (CAST(split_part(client_ip,'.',1) AS BIGINT)*16777216 + CAST(split_part(client_ip,'.',2) AS BIGINT)*65536
   + CAST(split_part(client_ip,'.',3) AS BIGINT)*256 + CAST(split_part(client_ip,'.',4) AS BIGINT)) BETWEEN g.start_num AND g.end_num),
hop AS (
 SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag("timestamp") OVER w AS pts FROM located
 WINDOW w AS (PARTITION BY "user" ORDER BY "timestamp", event_id)),
hop2 AS (
 SELECT *, (epoch_us("timestamp") - epoch_us(pts)) / 3.6e9 AS hours,
  2 * 6371.0088 * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2)
   + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS distance_km
 FROM hop WHERE plat IS NOT NULL),
travel AS (SELECT *, distance_km / hours AS speed_kmh FROM hop2 WHERE hours > 0 AND distance_km > 50 AND distance_km / hours > 800)"""

ENTROPY = ("(-list_sum(list_transform(list_filter(list_distinct(string_split({q}, '')), lambda c: c <> ''), "
           "lambda c: ((length({q}) - length(replace({q}, c, ''))) / CAST(length({q}) AS DOUBLE)) * "
           "log2((length({q}) - length(replace({q}, c, ''))) / CAST(length({q}) AS DOUBLE)))))")

TOUCHED = ("list_distinct(list_transform(regexp_extract_all({q}, "
           "'(?i)(?:\\bFROM\\b|\\bJOIN\\b|\\bUPDATE\\b|\\bINTO\\b)\\s+([`''\"]?\\w+[`''\"]?(?:\\.[`''\"]?\\w+[`''\"]?)?)', 1), "
           "lambda t: lower(regexp_replace(t, '[`''\"]', '', 'g'))))")

SECONDS = "(hour(\"timestamp\") * 3600 + minute(\"timestamp\") * 60 + (epoch_us(\"timestamp\") % 60000000) / 1e6)"


def shift(a: str = "a") -> str:
    t = f"((epoch_us({a}.\"timestamp\") % 86400000000) / 1e6)"
    return (f"CASE WHEN o.s0 <= o.s1 THEN {t} BETWEEN o.s0 AND o.s1 ELSE ({t} >= o.s0 OR {t} <= o.s1) END")


# Rule names by key, as in the rule table.
LABELS = {
    "ACCESS_ANOMALY": {"r01": "Concurrent Login", "r02": "Brute-force Success", "r03": "Impossible Travel"},
    "INSIDER_THREAT": {"r04": "Service Account Misuse", "r05": "Admin Privilege Abuse", "r06": "Sensitive Table Access",
                       "r07": "Late Night Query", "r08": "Ghost Account Creation", "r09": "System Table Modification",
                       "r10": "Insecure Connection"},
    "TECHNICAL_ATTACK": {"r11": "SQL Injection", "r12": "DoS / Resource Exhaustion", "r13": "High CPU Usage",
                         "r14": "Scan Efficiency", "r15": "Config Change", "r16": "High Entropy Query",
                         "r17": "Client Mismatch", "r18": "Disk Temp Table Abuse", "r19": "Index Evasion",
                         "r20": "Excessive Locking", "r21": "Suspicious Comment", "r22": "Warning Flooding",
                         "r23": "Password Hash Attack", "r24": "JSON Data Extraction"},
    "DATA_DESTRUCTION": {"r25": "Mass Deletion", "r26": "Old Data Modification", "r27": "Large Data Dump",
                         "r28": "Audit Log Manipulation", "r29": "Hidden View / Rename"},
    "MULTI_TABLE_ACCESS": {"r30": "Multi-Table Access"},
}

RULE_SQL = {
    "r01": """("user", time_bucket(INTERVAL 5 MINUTE, "timestamp")) IN (SELECT ("user", time_bucket(INTERVAL 5 MINUTE, "timestamp"))
      FROM audit GROUP BY "user", time_bucket(INTERVAL 5 MINUTE, "timestamp") HAVING count(DISTINCT client_ip) > 1)""",
    "r02": """error_code = 0 AND event_name IN ('connect', 'statement/com/Connect') AND client_ip IN (SELECT client_ip FROM audit
      WHERE error_code <> 0 GROUP BY client_ip, time_bucket(INTERVAL 60 MINUTE, "timestamp") HAVING count(*) > 1)""",
    "r03": "event_id IN (SELECT event_id FROM travel)",
    "r04": f"""("user" = 'user_3' AND client_ip NOT IN ('10.0.0.3', '10.0.1.3'))
      OR ("user" = 'user_6' AND client_ip NOT IN ('10.0.0.1', '10.0.1.1', '10.0.2.1'))
      OR ((("user" = 'user_3' AND NOT hour("timestamp") BETWEEN 6 AND 19) OR ("user" = 'user_6' AND NOT hour("timestamp") BETWEEN 8 AND 17))
       AND NOT EXISTS (SELECT 1 FROM overtime o WHERE o."user" = a."user" AND o."date" = CAST(a."timestamp" AS DATE) AND {shift()}))""",
    "r05": "regexp_matches(query, '(?i)CREATE USER|SET GLOBAL') AND \"user\" <> 'root'",
    "r06": """contains(query, 'hr_db') AND ("user" NOT IN ('user_1', 'user_2') OR hour("timestamp") < 8 OR hour("timestamp") >= 17)""",
    "r07": f"""((epoch_us("timestamp") % 86400000000) >= 79200000000 OR (epoch_us("timestamp") % 86400000000) <= 18000000000)
      AND NOT EXISTS (SELECT 1 FROM overtime o WHERE o."user" = a."user" AND o."date" = CAST(a."timestamp" AS DATE)
       AND (coalesce(trim(o.ip), '') = '' OR trim(o.ip) = a.client_ip) AND {shift()})""",
    "r08": """regexp_extract(query, '(?i)CREATE\\s+USER\\s+[''"`]?([a-zA-Z0-9_]+)', 1) NOT IN ('', 'ghost_1')""",
    "r09": "is_system_table = 1 AND NOT regexp_matches(query, '(?i)^\\s*(SELECT|SHOW|DESC)')",
    "r10": "\"user\" IN ('user_0') AND connection_type = 'TCP/IP'",
    "r11": "regexp_matches(query, '(?i)UNION SELECT|OR 1=1|--|#')",
    "r12": "execution_time_ms > 5000",
    "r13": "cpu_time_ms > 1000",
    "r14": "rows_examined > 1000 AND rows_returned < rows_examined * CAST(0.01 AS DOUBLE)",
    "r15": "regexp_matches(query, '(?i)SET GLOBAL|general_log')",
    "r16": ENTROPY.format(q="query") + " > 4.6",
    "r17": "regexp_matches(program_name, '(?i)sqlmap|nmap')",
    "r18": "created_tmp_disk_tables > 0",
    "r19": "(no_index_used = 1 OR select_full_join = 1) AND rows_examined > 1000",
    "r20": "lock_time_ms > 500",
    "r21": "has_comment = 1 AND is_system_table = 0",
    "r22": "warning_count > 5",
    "r23": "regexp_matches(query, '(?i)authentication_string|password_expired')",
    "r24": "regexp_matches(query, '(?i)JSON_EXTRACT|JSON_UNQUOTE|->>')",
    "r25": "event_name IN ('statement/sql/delete', 'statement/sql/drop') AND rows_affected > 500",
    "r26": "regexp_matches(query, '2019|2020|2021')",
    "r27": "regexp_matches(query, '(?i)customers|employees|salaries') AND rows_returned > 1000",
    "r28": """regexp_matches(query, '(?i)general_log|audit_log|slow_log|history')
      AND event_name IN ('statement/sql/delete', 'statement/sql/update', 'statement/sql/truncate')""",
    "r29": "regexp_matches(query, '(?i)RENAME\\s+TABLE|CREATE\\s+VIEW')",
    "r30": f"""regexp_matches(query, '(?i)SELECT|SHOW|DESCRIBE') AND len({TOUCHED.format(q='query')}) > 0
      AND ("user", time_bucket(INTERVAL 4 MINUTE, "timestamp")) IN (SELECT ("user", w) FROM (
       SELECT "user", time_bucket(INTERVAL 4 MINUTE, "timestamp") AS w, unnest({TOUCHED.format(q='query')}) AS t FROM audit
       WHERE regexp_matches(query, '(?i)SELECT|SHOW|DESCRIBE')) GROUP BY "user", w HAVING count(DISTINCT t) > 3)""",
}

FLAGS = "flags AS (SELECT a.*, " + ", ".join(f"({sql}) AS {key}" for key, sql in RULE_SQL.items()) + " FROM audit a)"


def _hit(group: str) -> str:
    return "(" + " OR ".join(LABELS[group]) + ")"


def _label(group: str) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {k} THEN '{v}' END" for k, v in LABELS[group].items()) + ")"


# The profile is learnt from rows before the split and tested on the rest.
PROFILE = """
profile AS (SELECT "user", hour("timestamp") AS hour, count(*) AS cnt FROM audit
 WHERE "timestamp" < TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL)"""

_SHORT = {"ACCESS_ANOMALY": "acc", "INSIDER_THREAT": "ins", "TECHNICAL_ATTACK": "tec", "DATA_DESTRUCTION": "des",
          "MULTI_TABLE_ACCESS": "mul"}
DETECTED = ("hits AS (SELECT *, " + ", ".join(f"{_hit(g)} AS h_{s}, {_label(g)} AS l_{s}" for g, s in _SHORT.items())
            + """ FROM flags),
det AS (SELECT h.*, (NOT (h_acc OR h_ins OR h_tec) AND coalesce(p.cnt, 0) < 25) AS h_pro
 FROM hits h LEFT JOIN profile p ON p."user" = h."user" AND p.hour = hour(h."timestamp")),
final AS (SELECT *, CASE WHEN h_pro THEN 'Rare Access Time (Profile Mismatch)' WHEN h_mul THEN l_mul WHEN h_des THEN l_des
  WHEN h_tec THEN l_tec WHEN h_ins THEN l_ins WHEN h_acc THEN l_acc END AS reason,
  CASE WHEN h_pro THEN 'UNUSUAL_BEHAVIOR' WHEN h_mul THEN 'MULTI_TABLE_ACCESS' WHEN h_des THEN 'DATA_DESTRUCTION'
  WHEN h_tec THEN 'TECHNICAL_ATTACK' WHEN h_ins THEN 'INSIDER_THREAT' WHEN h_acc THEN 'ACCESS_ANOMALY' END AS behavior_group
 FROM det)""")

_SETS = (("acc", "ACCESS_ANOMALY", "rule_access"), ("ins", "INSIDER_THREAT", "rule_insider"),
         ("tec", "TECHNICAL_ATTACK", "rule_technical"), ("des", "DATA_DESTRUCTION", "rule_destruction"))
ANOMALIES = ("anomalies AS (" + " UNION ALL ".join(
    f"""SELECT event_id, "timestamp", "user", client_ip, "database", query, substr(l_{s}, 1, 100) AS anomaly_type,
 '{g}' AS behavior_group, 1.0::DOUBLE AS score, 'Detected by {n}' AS reason, 'new' AS status, execution_time_ms, rows_returned, rows_affected
 FROM det WHERE h_{s}""" for s, g, n in _SETS) + """
 UNION ALL SELECT event_id, "timestamp", "user", client_ip, "database", query, 'Rare Access Time (Profile Mismatch)',
 'UNUSUAL_BEHAVIOR', 1.0::DOUBLE, concat('Access at ', CAST(hour("timestamp") AS VARCHAR), 'h is rare (< 25 times in history)'),
 'new', execution_time_ms, rows_returned, rows_affected FROM det WHERE h_pro)""")

SESSIONS = f"""
sess_rows AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS session_start FROM det WHERE h_mul),
sess_tabs AS (SELECT "user", session_start, list_sort(list_distinct(flatten(list({TOUCHED.format(q='query')})))) AS tables
 FROM sess_rows GROUP BY ALL),
sessions AS (SELECT r."user", r.session_start, arg_min(client_ip, ("timestamp", event_id)) AS client_ip, min("timestamp") AS start_time,
 max("timestamp") AS end_time, count(*) AS query_count, any_value(t.tables) AS tables, any_value(len(t.tables)) AS n_tables
 FROM sess_rows r JOIN sess_tabs t ON t."user" = r."user" AND t.session_start = r.session_start
 GROUP BY r."user", r.session_start HAVING any_value(len(t.tables)) >= 2)"""

_LAYERS = {"audit": [ADAPTER], "overtime": [ADAPTER, OVERTIME], "geo": [ADAPTER, GEO],
           "flags": [ADAPTER, OVERTIME, GEO, FLAGS], "profile": [ADAPTER, PROFILE],
           "det": [ADAPTER, OVERTIME, GEO, FLAGS, PROFILE, DETECTED],
           "anomalies": [ADAPTER, OVERTIME, GEO, FLAGS, PROFILE, DETECTED, ANOMALIES],
           "sessions": [ADAPTER, OVERTIME, GEO, FLAGS, PROFILE, DETECTED, SESSIONS],
           "all": [ADAPTER, OVERTIME, GEO, FLAGS, PROFILE, DETECTED, ANOMALIES, SESSIONS]}


def sql(layer: str, body: str, *ctes: str) -> str:
    """``body`` over the named layer; extra CTEs come between. Layers are kept once computed."""
    parts = list(_LAYERS[layer]) + list(ctes)
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
