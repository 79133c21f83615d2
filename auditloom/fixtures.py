"""Turns the driver's ``events`` table into audit records, and derives the side tables from given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.config import RuleConfig, ServiceAccount
from auditloom.functions.joins import spread
from auditloom.schema import conform

FIXTURE_CONFIG = RuleConfig(
    brute_force_attempts=1,
    brute_force_window="60 minutes",
    admin_keywords=("CREATE USER", "SET GLOBAL"),
    sensitive_tables=("hr_db",),
    sensitive_allowed_users=("user_1", "user_2"),
    hr_authorized_users=("ghost_1",),
    restricted_connection_users=("user_0",),
    sqli_keywords=("UNION SELECT", "OR 1=1", "--", "#"),
    max_query_entropy=4.6,
    disallowed_programs=("sqlmap", "nmap"),
    min_occurrences_threshold=25,
    service_accounts={"user_3": ServiceAccount(("10.0.0.3", "10.0.1.3"), tuple(range(6, 20))),
                      "user_6": ServiceAccount(("10.0.0.1", "10.0.1.1", "10.0.2.1"), tuple(range(8, 18)))},
    admin_user="user_5",
)
PROFILE_SPLIT = "2024-01-16 00:00:00"

_TEXT = """
CASE
 WHEN event_type='click' THEN concat('SELECT * FROM sales_db.orders o JOIN sales_db.customers c ON o.cid = c.id WHERE o.id = ', k)
 WHEN event_type='view' THEN concat('SELECT s.amount FROM hr_db.salaries s JOIN hr_db.employees e ON s.eid = e.id LIMIT ', k*100)
 WHEN event_type='purchase' THEN concat('INSERT INTO sales_db.orders VALUES (', k, ', ''abc'')')
 WHEN event_type='signup' AND k < 10 THEN concat('CREATE USER ''ghost_', k, ''' IDENTIFIED BY ''x''')
 WHEN event_type='signup' AND k < 20 THEN 'RENAME TABLE sales_db.t1 TO sales_db.t2'
 WHEN event_type='signup' AND k < 30 THEN 'SELECT JSON_EXTRACT(doc, ''$.a'') FROM sales_db.docs /* probe */'
 WHEN event_type='signup' AND k < 40 THEN 'UPDATE sales_db.orders SET note = ''x'' WHERE fiscal_year = 2020'
 WHEN event_type='signup' THEN concat('UPDATE sales_db.customers SET name = ''n'' WHERE id = ', k)
 WHEN k % 4 = 0 THEN concat('SELECT * FROM users WHERE id = ', k, ' OR 1=1 -- x')
 WHEN k % 4 = 1 THEN 'SELECT name FROM products UNION SELECT authentication_string FROM mysql.user'
 WHEN k % 4 = 2 THEN concat('DELETE FROM app_db.audit_log WHERE id < ', k)
 ELSE 'SET GLOBAL general_log = OFF' END"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as conformed audit records; one projection over one scan."""
    return conform(audit_log_raw(spark, sf_dir))


def audit_log_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(read_table(spark, sf_dir, "events")).selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "CAST(get_json_object(props,'$.k') AS INT) AS k")
    a = e.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), "k", "value",
        F.expr("concat('user_', user_id % 8)").alias("user"),
        F.expr("concat('10.0.', k % 3, '.', user_id % 5)").alias("client_ip"),
        F.expr("CASE WHEN event_type='view' THEN 'hr_db' WHEN event_type='error' THEN 'mysql' ELSE 'sales_db' END")
        .alias("database"),
        F.expr(_TEXT).alias("query"),
        F.expr("CASE WHEN event_type='error' AND k % 2 = 0 THEN 1045 ELSE 0 END").alias("error_code"),
        F.expr("value*100").alias("execution_time_ms"), F.expr("value*12").alias("cpu_time_ms"),
        F.expr("value*7").alias("lock_time_ms"),
        F.expr("CASE WHEN k % 9 = 0 THEN 1L ELSE CAST(floor(value*10) AS BIGINT) END").alias("rows_returned"),
        F.expr("CAST(floor(value*200) AS BIGINT)").alias("rows_examined"))
    return a.selectExpr(
        "event_id", "timestamp", "user", "client_ip", "database", "query", "error_code", "execution_time_ms",
        "cpu_time_ms", "lock_time_ms", "rows_returned", "rows_examined",
        """CASE WHEN query LIKE 'UPDATE sales_db.customers%' AND k % 5 = 0 THEN 'connect'
          WHEN query LIKE 'SELECT%' THEN 'statement/sql/select' WHEN query LIKE 'INSERT%' THEN 'statement/sql/insert'
          WHEN query LIKE 'UPDATE%' THEN 'statement/sql/update' WHEN query LIKE 'DELETE%' THEN 'statement/sql/delete'
          WHEN query LIKE 'CREATE USER%' THEN 'statement/sql/create_user'
          WHEN query LIKE 'RENAME%' THEN 'statement/sql/rename_table' ELSE 'statement/sql/set_option' END AS event_name""",
        "CASE WHEN query LIKE 'SELECT%' THEN 0L ELSE CAST(floor(value*10) AS BIGINT) END AS rows_affected",
        "CASE WHEN k % 2 = 0 THEN 'TCP/IP' ELSE 'Socket' END AS connection_type",
        "CASE WHEN k = 7 THEN 'sqlmap' ELSE 'app' END AS program_name",
        "k % 8 AS warning_count", "k % 2 AS no_index_used", "k % 3 AS select_full_join",
        "CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS created_tmp_disk_tables",
        "CASE WHEN database IN ('mysql','sys','information_schema','performance_schema') THEN 1 ELSE 0 END AS is_system_table",
        "CASE WHEN query LIKE '%--%' OR query LIKE '%/*%' OR query LIKE '%#%' THEN 1 ELSE 0 END AS has_comment",
        "k", "value")


def overtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overtime tickets derived from orders: one per order of the user and day it maps to."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "concat('user_', o_custkey % 8) AS user",
        "date_add(DATE'2024-01-01', CAST(o_orderkey % 30 AS INT)) AS date",
        "CASE WHEN o_orderkey % 2 = 0 THEN '22:00:00' ELSE '01:00:00' END AS start",
        "CASE WHEN o_orderkey % 2 = 0 THEN '00:30:00' ELSE '02:30:00' END AS end",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('10.0.', o_custkey % 3, '.', o_custkey % 5) END AS ip").distinct()


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address range per nation: 10.0.<key>.0-255 at a place that depends on the key."""
    return read_table(spark, sf_dir, "nation").selectExpr(
        "CAST(167772160 + n_nationkey * 256 AS BIGINT) AS start_num",
        "CAST(167772160 + n_nationkey * 256 + 3 AS BIGINT) AS end_num",
        "CAST(-60 + n_nationkey * 20 AS DOUBLE) AS lat", "CAST(n_nationkey * 30 AS DOUBLE) AS lon")


# Statement shapes that the audit adapter does not produce; ``k`` is a number below 100.
STATEMENT_SHAPES = (
    "concat('USE `shop_', k, '`')",
    "concat('CREATE DATABASE IF NOT EXISTS lake_', k)",
    "'SHOW TABLES FROM mysql'",
    "concat('CALL ops_db.refresh(', k, ')')",
    "'DESCRIBE hr_db.salaries'",
    "concat('SELECT `u`.`id`, count(*) FROM `crm`.`users` u LEFT JOIN crm.orders o ON o.uid = u.id WHERE u.age > ', k, "
    "' AND o.state = \"open\" OR u.vip = 1 GROUP BY u.id, u.age ORDER BY u.id LIMIT 10')",
    "'SELECT * FROM (SELECT id FROM mysql.user WHERE host IN (SELECT host FROM t2)) x'",
    "concat('LOAD DATA INFILE ''f'' INTO TABLE stage.t', k)",
    "concat('SELECT a FROM t INTO OUTFILE ''/tmp/x', k, '''')",
    "'SELECT SLEEP (5), 0xDEADBEEF'",
    "concat('GRANT ALL ON *.* TO ''u', k, '''@''h''')",
    "concat('  truncate table logs_', k, ' ')",
    "concat('INSERT IGNORE INTO audit.t', k, ' SELECT * FROM stage.s UNION SELECT 1 # x')",
    "concat('/* c */ UPDATE `fin`.`acc` SET x = ''abc''   WHERE id = ', k, ' AND y = 2 -- tail')",
    "'ALTER USER root IDENTIFIED BY \"pw1\"'",
    "concat('note without a verb ', k)",
    # Words in literals and comments, and nested sub-queries.
    "'SELECT ''x JOIN y WHERE (SELECT'' AS a, \"AND\" FROM t1 /* JOIN t9 ( */ -- WHERE (SELECT FROM t8'",
    "concat('SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = (SELECT max(e) FROM (SELECT ', k, ' AS e) v)) AND f(1, (2)) = (SELECT 3) LIMIT 5')",
    "concat('SELECT `limit`, count(*) FROM/* x */`big`.orders o JOIN ( SELECT 1) p WHERE n = ''it''''s AND JOIN'' OR m > ', k, ' GROUP BY n, m ORDER BY 1 # LIMIT')",
)


def statements_sql() -> str:
    """The shapes as one CASE over ``id`` (same text for Spark and the check)."""
    n = len(STATEMENT_SHAPES)
    arms = " ".join(f"WHEN id % {n} = {i} THEN {s}" for i, s in enumerate(STATEMENT_SHAPES))
    return f"CASE {arms} END"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per order, cycling through the shapes."""
    return (spread(read_table(spark, sf_dir, "orders"))
            .selectExpr("o_orderkey AS id", "CAST(o_custkey % 100 AS INT) AS k")
            .selectExpr("id", "k", f"{statements_sql()} AS query"))
