"""Whether a text touches a table is told without making the names."""

import re

from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions import text
from auditloom.operators import detect as D
from auditloom.schema import conform

TEXTS = ["", "x", "set global a", "SeT GlObAl", "set  global", "ſet global", "SET GLOBAL", "straße", "STRASSE", "strasse", "ıd kelvin K", "a->>b", "a-> >b", "General_Log\n",
         "é set global é", "İset global", "ŉ--", None, "insert into t", "INTO  `a`.`b`", "select from", "select 1 from\tx", "updatex t", "join (select", "show tables from db"]


def test_touches_table(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "query string")
    plan = df.select(D.reads_tables().alias("reads"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    rows = df.select(text.touches_table(F.col("query")).alias("got"), (F.size(text.touched_tables(F.col("query"))) > 0).alias("want"), D.reads_tables().alias("reads")).collect()
    assert [r.got for r in rows] == [r.want if t is not None else None for r, t in zip(rows, TEXTS)]
    assert all(r.reads is not None for r in rows)


def test_word_tests_before_patterns_keep_every_hit(spark):
    """Row rules look for words before they run a pattern; no hit of the pattern may be lost, whatever the letters around it."""
    words = ("set global", "--", "union SELECT", "straße", "1=1")
    df = spark.createDataFrame([(t,) for t in TEXTS + ["UNION select́", "x STRAßE 1=1", "Straße", "unionſelect"]], "query string")
    q = F.col("query")
    rows = df.select(text.spots_any(q, words).alias("got"), text.has_any(q, words).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert any(r.want for r in rows) and any(r.want is False for r in rows)


def test_row_rules_are_no_part_of_one_large_method(spark, tmp_path):
    """The rules in one method with joins and labels passed the size up to which the JVM compiles a method."""
    spark.range(5).selectExpr("id AS event_id", "timestamp'2024-01-10 12:00:00' AS timestamp", "concat('u', id) AS user", "concat('SELECT ', id) AS query",
                              "concat('10.0.0.', id) AS client_ip", "date_trunc('hour', timestamp) AS window_start").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    sides = [F.broadcast(rows.select(*c).distinct()) for c in (("user", "window_start"), ("user", "window_start"), ("client_ip",))]
    logs = D.detect(conform(rows.drop("window_start")), RuleConfig(), known=D.Known(*sides)).logs
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = logs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    rules = [line for line in plan.splitlines() if "AS r11#" in line]
    assert rules and not any(re.match(r"[ :+-]*\*\(", line) for line in rules)
