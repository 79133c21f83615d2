"""Per-row feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.functions import records, text
from auditloom.operators import features as FE
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import audit
from auditloom.schema import conform, safe_bool, safe_double, safe_long

# The same statements for the check.
STMTS = ("stm AS (SELECT o_orderkey AS id, CAST(o_custkey % 100 AS INT) AS k FROM orders), "
         f"stmts AS (SELECT id, k, {X.statements_sql()} AS query FROM stm)")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def stm(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join((STMTS, *ctes)) + " " + body


def count_sql(pattern: str, col: str = "query") -> str:
    return f"CAST(len(regexp_extract_all({col}, {q(pattern)})) AS INTEGER)"


def has_sql(pattern: str, col: str = "query") -> str:
    return f"CAST(regexp_matches({col}, {q(pattern)}) AS INTEGER)"


NORM = (r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '"\w+"', '"?"', 'g'), """
        r"""'''\w+''', '''?''', 'g'), '\d+', '?', 'g'), '^\s+|\s+$', '', 'g')""")
STRIP = r"regexp_replace(query, '^\s+|\s+$', '', 'g')"
FIRST = rf"regexp_extract(upper({STRIP}), '^(\w+)', 1)"
VERBS = ", ".join(q(v) for v in text.SQL_VERBS)
COMMAND = (f"CASE WHEN {FIRST} IN ({VERBS}) THEN {FIRST} WHEN contains(upper(query), 'SELECT') THEN 'SELECT' "
           "WHEN contains(upper(query), 'INSERT') THEN 'INSERT' WHEN contains(upper(query), 'UPDATE') THEN 'UPDATE' "
           "WHEN contains(upper(query), 'DELETE') THEN 'DELETE' ELSE 'UNKNOWN' END")
# Code without literals and comments, in the words of the check's own regular expressions.
PIECES = (r"(?s)'(?:[^'\\]|\\.|'')*(?:'|\z)|" + r'"(?:[^"\\]|\\.|"")*(?:"|\z)' + r"|`[^`]*(?:`|\z)|--[^\n]*|#[^\n]*|/\*.*?(?:\*/|\z)|[^'" + '"' + r"`#/-]+|.")


def code_sql(quotes: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(query, {q(PIECES)}), lambda p: CASE WHEN p[1] IN ({quotes}) THEN '?' "
            "WHEN p[1] = '#' OR p[1:2] IN ('--', '/*') THEN ' ' ELSE p END), '')")


CODE, NAMED = code_sql("'''', '\"', '`'"), code_sql("'''', '\"'")
READ_TABLES = (f"list_distinct(list_transform(list_zip(regexp_extract_all({NAMED}, {q(text.READ_TABLE_PATTERN)}, 1), "
               f"regexp_extract_all({NAMED}, {q(text.READ_TABLE_PATTERN)}, 2)), "
               "lambda p: lower(CASE WHEN coalesce(p[1], '') = '' THEN p[2] ELSE p[1] || '.' || p[2] END)))")
DB_FROM_SQL = "lower(coalesce(" + ", ".join(
    f"nullif(regexp_extract(query, {q('(?i)' + p)}, 1), '')" for p in text.DATABASE_PATTERNS) + "))"


def register(cat: Catalog) -> None:
    def stmts(sp, sf):
        return X.statements(sp, sf)

    def raw(sp, sf):
        return X.audit_log_raw(sp, sf).select(
            F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
            "event_id", "query", F.when(F.col("k") % 5 != 0, F.col("rows_returned")).alias("rows_returned"))
    cat.add("f01_preprocess", lambda sp, sf: FE.preprocess(conform(raw(sp, sf))).select(
        "event_id", "timestamp", "rows_returned", "rows_affected", "execution_time_ms", "user"),
        S.sql("audit", """SELECT event_id, "timestamp", CASE WHEN k % 5 <> 0 THEN rows_returned ELSE 0 END AS rows_returned,
         CAST(0 AS BIGINT) AS rows_affected, 0.0::DOUBLE AS execution_time_ms, 'unknown' AS "user" FROM audit WHERE event_id % 7 <> 0"""),
        ts=("timestamp",))
    cat.add("f02_normalize_query", lambda sp, sf: stmts(sp, sf).select("id", text.normalize_query(F.col("query")).alias("normalized")),
            stm(f"SELECT id, {NORM} AS normalized FROM stmts"))
    det = (r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(query), '\s+', ' ', 'g'), """
           r"""'''[^'']*''', '''STRING''', 'g'), '\b\d+\b', 'NUMBER', 'g'), '/\*.*?\*/', '', 'g'), '(?m)--.*$', '', 'g'), '^\s+|\s+$', '', 'g')""")
    cat.add("f03_normalize_for_detection", lambda sp, sf: stmts(sp, sf).select(
        "id", text.normalize_for_detection(F.col("query")).alias("normalized")), stm(f"SELECT id, {det} AS normalized FROM stmts"))
    cat.add("f04_query_length", lambda sp, sf: FE.preprocess(audit(sp, sf)).select("event_id", "query_length"),
            S.sql("audit", f"SELECT event_id, length({NORM}) AS query_length FROM audit"), ints=("query_length",))
    cat.add("f05_entropy", lambda sp, sf: stmts(sp, sf).select("id", text.entropy(F.col("query")).alias("entropy")),
            stm(f"SELECT id, {S.ENTROPY.format(q='query')} AS entropy FROM stmts"), rnd={"entropy": 6})
    cat.add("f06_time_features", lambda sp, sf: audit(sp, sf).select(
        "event_id", *[c.alias(n) for n, c in FE.time_features(F.col("timestamp")).items()]),
        S.sql("audit", """SELECT event_id, sin(2 * pi() * hour("timestamp") / 24) AS hour_sin, cos(2 * pi() * hour("timestamp") / 24) AS hour_cos,
         CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend, CAST(hour("timestamp") < 6 AS INTEGER) AS is_late_night,
         CAST(hour("timestamp") BETWEEN 8 AND 18 AS INTEGER) AS is_work_hours FROM audit"""), rnd={"hour_sin": 6, "hour_cos": 6})

    def errors(sp, sf):
        return audit(sp, sf).withColumns({
            "error_message": F.when(F.col("error_code") != 0, F.concat(F.lit("Access DENIED for "), "user")),
            "error_count": F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)})
    cat.add("f07_error_flags", lambda sp, sf: errors(sp, sf).select(
        "event_id", "error_count", *[c.alias(n) for n, c in FE.error_features().items()]),
        S.sql("audit", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS error_count,
         CAST(event_id % 11 = 0 OR error_code <> 0 AS INTEGER) AS has_error, CAST(error_code <> 0 AS INTEGER) AS is_access_denied FROM audit"""))
    junk = "CASE k % 7 WHEN 0 THEN '12.7' WHEN 1 THEN 'nan' WHEN 2 THEN 'abc' WHEN 3 THEN 'inf' WHEN 4 THEN '-3' WHEN 5 THEN ' On ' END"
    cat.add("f08_safe_casts", lambda sp, sf: audit(sp, sf).withColumn("v", F.expr(junk)).select(
        "event_id", safe_long(F.col("v")).alias("as_int"), safe_double(F.when(F.col("v") != "inf", F.col("v"))).alias("as_double"),
        safe_bool(F.col("v")).alias("as_bool")),
        S.sql("audit", """SELECT event_id, CAST(CASE k % 7 WHEN 0 THEN 12 WHEN 4 THEN -3 ELSE 0 END AS BIGINT) AS as_int,
         CAST(CASE k % 7 WHEN 0 THEN 12.7 WHEN 4 THEN -3 ELSE 0 END AS DOUBLE) AS as_double, coalesce(k % 7 = 5, false) AS as_bool FROM audit"""))
    cat.add("f09_retrieval_speed", lambda sp, sf: audit(sp, sf).select("event_id", FE.retrieval_speed().alias("speed")),
            S.sql("audit", "SELECT event_id, rows_returned / (execution_time_ms + 0.001::DOUBLE) AS speed FROM audit"), rnd={"speed": 6})
    cat.add("f10_scan_efficiency", lambda sp, sf: audit(sp, sf).select("event_id", FE.scan_efficiency().alias("scan_efficiency")),
            S.sql("audit", "SELECT event_id, rows_returned / CAST(rows_examined + 1 AS DOUBLE) AS scan_efficiency FROM audit"),
            rnd={"scan_efficiency": 6})
    cat.add("f11_timer_units", lambda sp, sf: audit(sp, sf).select("event_id", records.timer_ms(
        F.col("rows_examined") * 1_000_000_007).alias("ms"), records.timer_ms(F.col("rows_examined") * 1_000_000_007, 1e12).alias("sec")),
        S.sql("audit", "SELECT event_id, rows_examined * 1000000007 / 1e9::DOUBLE AS ms, rows_examined * 1000000007 / 1e12::DOUBLE AS sec FROM audit"),
        rnd={"ms": 6, "sec": 6})
    host = "CASE k % 4 WHEN 0 THEN client_ip || ':' || (3000 + k) WHEN 1 THEN 'localhost' WHEN 2 THEN client_ip END"
    cat.add("f12_client_ip", lambda sp, sf: audit(sp, sf).withColumn("host", F.expr(host)).select(
        "event_id", text.client_ip(F.col("host")).alias("ip")),
        S.sql("audit", "SELECT event_id, CASE k % 4 WHEN 1 THEN 'localhost' WHEN 3 THEN 'unknown' ELSE client_ip END AS ip FROM audit"))
    schema = "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN 'CRM' ELSE 'null' END"
    cat.add("f13_resolve_database", lambda sp, sf: stmts(sp, sf).withColumn("cur", F.expr(schema)).select(
        "id", text.resolve_database(F.col("cur"), F.col("query")).alias("db")),
        stm(f"SELECT id, CASE WHEN k % 5 = 3 THEN 'crm' ELSE coalesce({DB_FROM_SQL}, 'unknown') END AS db FROM stmts"))
    cat.add("f14_database_from_sql", lambda sp, sf: stmts(sp, sf).select("id", text.database_from_sql(F.col("query")).alias("db")),
            stm(f"SELECT id, {DB_FROM_SQL} AS db FROM stmts"))
    cat.add("f15_read_tables", lambda sp, sf: stmts(sp, sf).select("id", F.array_sort(text.read_tables(F.col("query"))).alias("tables")),
            stm(f"SELECT id, list_sort({READ_TABLES}) AS tables FROM stmts"), arr=("tables",))
    cat.add("f16_touched_tables", lambda sp, sf: stmts(sp, sf).select("id", F.array_sort(text.touched_tables(F.col("query"))).alias("tables")),
            stm(f"SELECT id, list_sort({S.TOUCHED.format(q='query')}) AS tables FROM stmts"), arr=("tables",))
    cat.add("f17_command_type", lambda sp, sf: stmts(sp, sf).select("id", text.command_type(F.col("query")).alias("command_type")),
            stm(f"SELECT id, {COMMAND} AS command_type FROM stmts"))
    two = rf"regexp_replace(regexp_extract(upper({STRIP}), '^(\w+\s+\w+)', 1), '\s+', ' ', 'g')"
    lists = {n: ", ".join(q(v) for v in vs) for n, vs in (("risky", text.RISKY_COMMANDS), ("admin", text.ADMIN_COMMANDS),
                                                          ("dcl", text.DCL_COMMANDS), ("ddl", text.DDL_COMMANDS))}
    cat.add("f18_command_flags", lambda sp, sf: stmts(sp, sf).withColumn("command_type", text.command_type(F.col("query"))).select(
        "id", *[c.alias(n) for n, c in {**FE.command_features(F.col("query")), **FE.publisher_flags(F.col("query"))}.items()]),
        stm(f"""SELECT id, CAST(cmd IN ({lists['risky']}) OR two IN ('CREATE USER', 'ALTER USER') AS INTEGER) AS is_risky_command,
         CAST(cmd IN ({lists['admin']}) OR two IN ({lists['admin']}) AS INTEGER) AS is_admin_command,
         CAST(cmd IN ({lists['dcl']}) OR two IN ({lists['dcl']}) AS INTEGER) AS is_dcl, CAST(cmd IN ({lists['ddl']}) AS INTEGER) AS is_ddl,
         CAST(regexp_matches(upper(query), 'GRANT|REVOKE|CREATE USER') AS INTEGER) AS pub_is_admin_command,
         CAST(regexp_matches(upper(query), 'DROP|TRUNCATE') AS INTEGER) AS pub_is_risky_command,
         CAST(contains(query, '--') OR contains(query, '/*') AS INTEGER) AS pub_has_comment
         FROM (SELECT *, {COMMAND} AS cmd, {two} AS two FROM stmts)"""))
    cat.add("f19_shape_counts", lambda sp, sf: stmts(sp, sf).withColumn("accessed_tables", text.read_tables(F.col("query"))).select(
        "id", *[c.alias(n) for n, c in FE.shape_features(F.col("query")).items()]),
        # Depth by walking the parentheses one by one.
        stm(f"""SELECT id, CAST(len({READ_TABLES}) AS INTEGER) AS num_tables, {count_sql(r'(?i)\bJOIN\b', CODE)} AS num_joins,
         {count_sql(r'(?i)\bWHERE\b', CODE)} AS num_where_conditions, CAST(least(depth, 10) AS INTEGER) AS subquery_depth,
         CASE WHEN {FIRST} IN ({VERBS}) THEN 0 ELSE 1 END AS is_parse_failed FROM stmts JOIN deepest USING (query)""",
            rf"""signs AS (SELECT DISTINCT query, regexp_extract_all({CODE}, '(?i)\(\s*SELECT\b|\(|\)') AS s FROM stmts),
            walk AS (SELECT query, s, 0 AS i, '' AS opened FROM signs UNION ALL SELECT query, s, i + 1,
             CASE WHEN s[i + 1] = ')' THEN left(opened, greatest(length(opened) - 1, 0)) WHEN s[i + 1] = '(' THEN opened || '-' ELSE opened || 'S' END FROM walk WHERE i < len(s)),
            deepest AS (SELECT query, max(length(replace(opened, '-', ''))) AS depth FROM walk GROUP BY query)""").replace("WITH ", "WITH RECURSIVE ", 1))
    where = r"regexp_extract(code, '(?is)\bWHERE\b(.*)', 1)"

    def clause(word):
        body = rf"regexp_extract(code, '(?is)\b{word}\s+BY\s+(.*?)(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\)|;|$)', 1)"
        return f"CAST(CASE WHEN {body} = '' THEN 0 ELSE len(string_split({body}, ',')) END AS INTEGER)"
    cat.add("f20_shape_detailed", lambda sp, sf: stmts(sp, sf).select(
        "id", *[c.alias(n) for n, c in FE.shape_features_detailed(F.col("query")).items()]),
        stm(f"""SELECT id, {count_sql(r'(?i)\bJOIN\b', 'code')} AS num_joins,
         CAST(CASE WHEN regexp_matches(code, '(?i)\\bWHERE\\b') THEN {count_sql(r'(?i)\b(?:AND|OR)\b', where)} + 1 ELSE 0 END AS INTEGER) AS num_where_conditions,
         {clause('GROUP')} AS num_group_by_cols, {clause('ORDER')} AS num_order_by_cols, {has_sql(r'(?i)\bLIMIT\b', 'code')} AS has_limit,
         {has_sql(r'(?i)\(\s*SELECT\b', 'code')} AS has_subquery, {has_sql(r'(?i)\bUNION\b', 'code')} AS has_union, {has_sql(r'(?i)\bWHERE\b', 'code')} AS has_where FROM (SELECT id, {CODE} AS code FROM stmts)"""))
    sens = ", ".join(q(t) for t in text.SENSITIVE_TABLES)
    syss = ", ".join(q(t) for t in text.SYSTEM_SCHEMAS)
    acc = ("is_sensitive_access", "is_system_access")
    cat.add("f21_access_flags", lambda sp, sf: stmts(sp, sf).withColumn("t", text.read_tables(F.col("query"))).select(
        "id", *[FE.access_features(F.col("t"))[n].alias(n) for n in acc]),
        stm(f"""SELECT id, CAST(len(list_filter({READ_TABLES}, lambda t: list_contains([{sens}], t)
          OR list_contains([{sens}], string_split(t, '.')[-1]))) > 0 AS INTEGER) AS is_sensitive_access,
         CAST(len(list_filter({READ_TABLES}, lambda t: contains(t, '.') AND list_contains([{syss}], string_split(t, '.')[1]))) > 0 AS INTEGER) AS is_system_access FROM stmts"""))
    cat.add("f22_sensitive_table_count", lambda sp, sf: stmts(sp, sf).withColumn("t", text.read_tables(F.col("query"))).select(
        "id", FE.access_features(F.col("t"))["accessed_sensitive_tables"].alias("n")),
        stm(f"""SELECT id, CAST(len(list_filter({READ_TABLES}, lambda t: len(list_filter([{sens}], lambda s: contains(t, s))) > 0)) AS INTEGER) AS n FROM stmts"""))
    cat.add("f23_text_flags", lambda sp, sf: stmts(sp, sf).select("id", *[c.alias(n) for n, c in FE.text_flags(F.col("query")).items()]),
            stm(f"""SELECT id, {has_sql('--|/[*]|#')} AS has_comment, CAST(contains(upper(query), '0X') AS INTEGER) AS has_hex,
             CAST(contains(upper(query), 'SELECT *') AS INTEGER) AS is_select_star, CAST(contains(upper(query), 'INTO OUTFILE') AS INTEGER) AS has_into_outfile,
             CAST(contains(upper(query), 'LOAD DATA') AS INTEGER) AS has_load_data, {has_sql(r'(?i)SLEEP\s*\(|BENCHMARK\s*\(')} AS has_sleep_benchmark FROM stmts"""))
    cat.add("f24_is_system_table", lambda sp, sf: audit(sp, sf).select(
        "event_id", text.flag(F.col("database").isin(*text.SYSTEM_SCHEMAS)).alias("is_system")),
        S.sql("audit", f'SELECT event_id, CAST("database" IN ({syss}) AS INTEGER) AS is_system FROM audit'))
    cat.add("f25_late_night", lambda sp, sf: audit(sp, sf).select(
        "event_id", ((F.hour("timestamp") <= 5) | (F.hour("timestamp") >= 23)).alias("late")),
        S.sql("audit", 'SELECT event_id, (hour("timestamp") <= 5 OR hour("timestamp") >= 23) AS late FROM audit'))
    tag = ("CASE WHEN k % 3 = 0 THEN query ELSE concat(query, ' /* SIM_META:', \"user\", '|', client_ip, '|3306|ID:', k, '|BEH:', "
           "CASE WHEN k % 2 = 0 THEN 'NORMAL' ELSE 'ATTACK' END, '|ANO:', k % 2, '|PROG:app_', k % 4, ' */') END")
    cat.add("f26_statement_tag", lambda sp, sf: records.read_tag(audit(sp, sf).withColumn(
        "query", F.expr(tag.replace('"user"', "user"))).withColumn("client_ip", F.lit("h:1"))).select(
        "event_id", "sim_user", "sim_ip", "beh_type", "is_anomaly", "sim_prog", "sim_os", "clean_query"),
        S.sql("audit", """SELECT event_id, "user" AS sim_user, CASE WHEN k % 3 = 0 THEN 'h' ELSE client_ip END AS sim_ip,
         CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'NORMAL' ELSE 'ATTACK' END AS beh_type, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 2 END AS is_anomaly,
         CASE WHEN k % 3 = 0 THEN 'Unknown' ELSE concat('app_', CAST(k % 4 AS VARCHAR)) END AS sim_prog, 'Unknown' AS sim_os, query AS clean_query FROM audit"""))
    cat.add("f27_error_host", lambda sp, sf: audit(sp, sf).select("event_id", records.rewrite_error_host(
        F.expr("CASE k % 3 WHEN 0 THEN concat('Access denied for user ''', user, '''@''localhost'' (1045)') WHEN 1 THEN 'other error' ELSE '' END"),
        F.col("client_ip")).alias("message")),
        S.sql("audit", """SELECT event_id, CASE k % 3 WHEN 0 THEN concat('Access denied for user ''', "user", '''@''', client_ip, ''' (1045)')
         WHEN 1 THEN 'other error' ELSE '' END AS message FROM audit"""))
    bucket = "CASE " + " ".join(f"WHEN starts_with(upper({STRIP}), '{v}') THEN '{v}'" for v in
                                ("SELECT", "INSERT", "UPDATE", "DELETE", "SHOW", "SET", "CREATE", "ALTER", "DROP")) + " ELSE 'OTHER' END"
    cat.add("f28_query_bucket", lambda sp, sf: stmts(sp, sf).select("id", text.query_bucket(F.col("query")).alias("bucket")),
            stm(f"SELECT id, {bucket} AS bucket FROM stmts"))
    cat.add("f29_score_value", lambda sp, sf: audit(sp, sf).select("event_id", records.score_value(
        F.expr("CASE WHEN k % 4 = 0 THEN 'n/a' WHEN k % 4 = 1 THEN CAST(k AS STRING) END"), F.expr("CASE WHEN k % 4 = 2 THEN k / 200.0D END"),
        F.expr("CASE WHEN k % 8 = 4 THEN 0.5D END")).alias("score")),
        S.sql("audit", """SELECT event_id, CASE WHEN k % 4 = 1 THEN CASE WHEN k > 1 THEN k / 100.0::DOUBLE ELSE CAST(k AS DOUBLE) END
         WHEN k % 4 = 2 THEN k / 200.0::DOUBLE WHEN k % 8 = 4 THEN 0.5::DOUBLE END AS score FROM audit"""), rnd={"score": 6})
    fmt = "CASE k % 4 WHEN 0 THEN '2024-01-01T00:00:00Z' WHEN 1 THEN '2024-01-01T00:00:00' WHEN 2 THEN '2024-01-01 00:00:00' ELSE '2024-01-01T00:00:00z' END"
    cat.add("f30_format_checks", lambda sp, sf: audit(sp, sf).withColumn("t", F.expr(fmt)).select(
        "event_id", records.timestamp_format(F.col("t")).alias("fmt"), records.mixed_case(F.initcap("user")).alias("mixed"),
        records.non_numeric(F.expr("CASE WHEN k % 2 = 0 THEN '1.5' ELSE 'x1' END")).alias("bad_number")),
        S.sql("audit", """SELECT event_id, CASE k % 4 WHEN 0 THEN 'ISO_WITH_Z' WHEN 1 THEN 'ISO_NO_Z' WHEN 2 THEN 'NON_ISO'
         ELSE 'ISO_WITH_LOWERCASE_Z' END AS fmt, true AS mixed, (k % 2 <> 0) AS bad_number FROM audit"""))

    def grants(sp, sf):
        """Grants derived from customers: which users may do what."""
        return X.read_table(sp, sf, "customer").selectExpr(
            "concat('user_', c_custkey % 8) AS user",
            "CASE WHEN c_custkey % 8 = 0 THEN '*' WHEN c_custkey % 2 = 0 THEN 'sales_db' ELSE 'hr_db' END AS database",
            "CASE WHEN c_custkey % 8 = 2 THEN array('ALL') ELSE array('SELECT', 'INSERT') END AS commands").distinct()
    cat.add("f31_access_violations", lambda sp, sf: records.access_violations(audit(sp, sf), grants(sp, sf)).select(
        "event_id", "user", "database", "command"),
        S.sql("audit", """SELECT event_id, "user", "database", CASE WHEN regexp_matches(query, '^(SELECT|INSERT|UPDATE|DELETE)')
          THEN regexp_extract(query, '^(\\w+)', 1) ELSE 'UNKNOWN' END AS command FROM audit a WHERE "user" <> 'user_0'
         AND NOT ("database" = CASE WHEN "user" IN ('user_2', 'user_4', 'user_6') THEN 'sales_db' ELSE 'hr_db' END
          AND ("user" = 'user_2' OR regexp_matches(query, '^(SELECT|INSERT)')))"""))
