"""Data set quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.config import RuleConfig
from auditloom.operators import quality as G
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import audit
from auditloom.plans.q_monitor import PROBES, in_list, probes

NOW = "2024-01-30 00:00:00"


def labelled(sp, sf):
    """Audit rows with labels and errors as a data set: some messages are missing, some rows repeat."""
    a = audit(sp, sf)
    msg = F.expr("""CASE WHEN error_code = 0 THEN NULL WHEN k % 4 = 0 THEN 'Access denied' WHEN k % 4 = 2 THEN 'Unknown column' END""")
    d = a.select("event_id", "timestamp", "user", "database", "query", "error_code", F.expr("CAST(error_code <> 0 AS INT)").alias("has_error"), msg.alias("error_message"),
                 F.expr("CAST(k % 7 = 0 AS INT)").alias("is_anomaly"))
    return d.unionByName(d.where("event_id % 100 = 0"))


LABELLED = """lb0 AS (SELECT event_id, "timestamp", "user", "database", query, error_code, CAST(error_code <> 0 AS INTEGER) AS has_error,
  CASE WHEN error_code = 0 THEN NULL WHEN k % 4 = 0 THEN 'Access denied' WHEN k % 4 = 2 THEN 'Unknown column' END AS error_message, CAST(k % 7 = 0 AS INTEGER) AS is_anomaly FROM audit),
 lb AS (SELECT * FROM lb0 UNION ALL SELECT * FROM lb0 WHERE event_id % 100 = 0)"""
COLS = ("event_id", "timestamp", "user", "database", "query", "error_code", "has_error", "error_message", "is_anomaly")


def pool(sp, sf):
    """Pool documents, one per order: a database with one intent and its statements."""
    p = probes(sp, sf)
    body = F.to_json(F.create_map(F.concat(F.lit("db_"), (F.col("k") % 3).cast("string")), F.create_map(
        F.expr("CASE k % 4 WHEN 0 THEN 'read_report' WHEN 1 THEN 'sql_injection_test' WHEN 2 THEN 'update_row' ELSE 'empty_intent' END"),
        F.when(F.col("k") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.expr("CASE WHEN id % 5 = 0 THEN concat('SELECT * FROM hr_db.t', k) ELSE query END"))))))
    return G.explode_pool(p.select("id", body.alias("value")))


POOL = PROBES + """, pool AS (SELECT id, 'db_' || CAST(k % 3 AS VARCHAR) AS "database", CASE k % 4 WHEN 0 THEN 'read_report' WHEN 1 THEN 'sql_injection_test' WHEN 2 THEN 'update_row' ELSE 'empty_intent' END AS intent,
 CASE WHEN k % 4 = 3 THEN NULL WHEN id % 5 = 0 THEN concat('SELECT * FROM hr_db.t', CAST(k AS VARCHAR)) ELSE query END AS query FROM probes)"""
SCREEN = """scr AS (SELECT *, concat_ws(',', CASE WHEN (contains(upper(query), 'SELECT * FROM') OR contains(upper(query), 'LIKE ''%')) AND (contains(upper(query), 'FROM') OR contains(upper(query), 'JOIN')) THEN 'Index Evasion' END,
  CASE WHEN intent <> 'sql_injection_test' AND regexp_matches(query, 'inventory_db|finance_db|hr_db|admin_db') THEN 'Sensitive Table Access' END) AS reasons FROM pool WHERE query IS NOT NULL)"""


def register(cat: Catalog) -> None:
    def add(name, fn, body, **kw):
        cat.add(name, fn, S.sql("audit", body, LABELLED), **kw)
    q = '"'
    add("g01_null_counts", lambda sp, sf: G.null_counts(labelled(sp, sf)),
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({q}{c}{q} IS NULL)::BIGINT AS nulls, count_if({q}{c}{q} IS NULL) * 100.0::DOUBLE / count(*) AS percent FROM lb" for c in COLS), rnd={"percent": 6})
    add("g01_duplicates", lambda sp, sf: G.duplicate_count(labelled(sp, sf)), "SELECT (SELECT count(*) FROM lb) - count(*) AS duplicates, (SELECT count(*) FROM lb) AS total FROM (SELECT DISTINCT * FROM lb)")

    def missing(sp, sf):
        d = audit(sp, sf)
        gone = G.missing_columns(d.select("timestamp", "user", "query"))
        return d.groupBy().agg(F.count(F.lit(1)).alias("total")).withColumn("missing", F.lit(",".join(gone)))
    add("g01_missing_columns", missing, "SELECT count(*) AS total, 'database,has_error,is_anomaly' AS missing FROM audit")
    h = 'hour("timestamp")'
    bands = {"core": f"{h} BETWEEN 8 AND 11 OR {h} BETWEEN 13 AND 17", "extended": f"{h} IN (7, 18, 19)", "lunch": f"{h} = 12", "off": f"{h} >= 20 OR {h} <= 6", "weekend": 'isodow("timestamp") >= 6'}
    counts = ", ".join(f"count_if({c})::BIGINT AS {b}, count_if({c}) * 100.0::DOUBLE / count(*) AS {b}_percent" for b, c in bands.items())
    add("g02_hour_bands", lambda sp, sf: G.hour_bands(labelled(sp, sf)), f'SELECT count(*) AS total, {counts}, count_if(isodow("timestamp") < 6)::BIGINT AS weekday FROM lb', rnd={f"{b}_percent": 6 for b in bands})
    add("g03_user_activity", lambda sp, sf: G.user_activity(labelled(sp, sf)),
        'SELECT count(*) AS users, max(c) AS most, min(c) AS least, avg(c) AS mean, stddev_samp(c) AS std, quantile_cont(c, 0.5) AS median, stddev_samp(c) / avg(c) AS variation FROM (SELECT count(*) AS c FROM lb GROUP BY "user")',
        rnd={"mean": 4, "std": 4, "median": 4, "variation": 6})
    add("g03_top_users", lambda sp, sf: G.top_users(labelled(sp, sf), 5), 'SELECT "user", count(*) AS queries, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lb) AS share FROM lb GROUP BY 1 ORDER BY queries DESC, "user" LIMIT 5', rnd={"share": 6})
    add("g04_type_distribution", lambda sp, sf: G.type_distribution(labelled(sp, sf)),
        "SELECT CASE WHEN regexp_matches(upper(query), '^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP)') THEN regexp_extract(upper(query), '^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP)', 1) ELSE 'OTHER' END AS query_type, count(*) AS n FROM lb GROUP BY 1")
    add("g04_length_summary", lambda sp, sf: G.length_summary(labelled(sp, sf)),
        "SELECT avg(length(query)) AS mean, max(length(query)) AS max, min(length(query)) AS min, quantile_cont(length(query), 0.5) AS median FROM lb", rnd={"mean": 4, "median": 4}, ints=("max", "min"))
    add("g05_error_rate", lambda sp, sf: G.error_rate(labelled(sp, sf)),
        "SELECT *, CASE WHEN error_rate <= 1 THEN 'EXCELLENT' WHEN error_rate <= 5 THEN 'GOOD' WHEN error_rate <= 15 THEN 'MODERATE' ELSE 'HIGH' END AS band FROM (SELECT count(*) AS total, sum(has_error)::BIGINT AS errors, sum(has_error) * 100.0::DOUBLE / count(*) AS error_rate FROM lb)", rnd={"error_rate": 6})
    add("g05_anomaly_rate", lambda sp, sf: G.anomaly_rate(labelled(sp, sf)),
        "SELECT *, CASE WHEN anomaly_rate <= 2 THEN 'CLEAN' WHEN anomaly_rate <= 15 THEN 'NORMAL' WHEN anomaly_rate <= 40 THEN 'HIGH' ELSE 'EXTREME' END AS band FROM (SELECT count(*) AS total, sum(is_anomaly)::BIGINT AS anomalies, sum(is_anomaly) * 100.0::DOUBLE / count(*) AS anomaly_rate FROM lb)", rnd={"anomaly_rate": 6})
    add("g06_rank_frequency", lambda sp, sf: G.rank_frequency(labelled(sp, sf), "query"), "SELECT query, n, rank() OVER (ORDER BY n DESC) AS rank_from, rank() OVER (ORDER BY n DESC) + count(*) OVER (PARTITION BY n) - 1 AS rank_to FROM (SELECT query, count(*) AS n FROM lb GROUP BY 1)")
    add("g07_hourly_activity", lambda sp, sf: G.hourly_activity(labelled(sp, sf)), 'SELECT hour("timestamp") AS hour, count(*) AS n FROM lb GROUP BY 1', ints=("hour",))
    add("g07_daily_activity", lambda sp, sf: G.daily_activity(labelled(sp, sf)), 'SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS n, sum(is_anomaly)::BIGINT AS anomalies FROM lb GROUP BY 1')
    add("g07_peak_hours", lambda sp, sf: G.peak_hours(labelled(sp, sf)), 'SELECT hour("timestamp") AS hour, count(*) AS n FROM lb GROUP BY 1 ORDER BY n DESC, hour LIMIT 3', ints=("hour",))
    add("g08_database_usage", lambda sp, sf: G.database_usage(labelled(sp, sf)), 'SELECT "database", count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lb) AS share FROM lb GROUP BY 1', rnd={"share": 6})
    add("g08_distinct_counts", lambda sp, sf: G.distinct_counts(labelled(sp, sf), COLS),
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {q}{c}{q}) AS n FROM lb" for c in COLS))
    nulls = " + ".join(f"count_if({q}{c}{q} IS NULL)" for c in COLS)
    add("g09_quality_factors", lambda sp, sf: G.quality_factors(labelled(sp, sf), F.lit(NOW).cast("timestamp")),
        f"""SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 80 THEN 'Good' WHEN quality_score >= 70 THEN 'Fair' ELSE 'Poor' END AS rating FROM (
         SELECT *, round((completeness + consistency + validity + uniqueness) / 4, 9) AS quality_score FROM (SELECT 100 - ({nulls}) * 100.0::DOUBLE / (count(*) * {len(COLS)}) AS completeness, 100 - sum(has_error) * 100.0::DOUBLE / count(*) AS consistency,
          CASE WHEN count_if("timestamp" > TIMESTAMP '{NOW}') > 0 THEN 90.0::DOUBLE ELSE 100.0::DOUBLE END AS validity, 100 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lb))) * 100.0::DOUBLE / count(*) AS uniqueness FROM lb))""",
        rnd={"completeness": 6, "consistency": 6, "uniqueness": 6, "quality_score": 6})
    add("g10_quality_grade", lambda sp, sf: G.quality_grade(labelled(sp, sf), "user_[0-5]"),
        """SELECT points, points / 1.5::DOUBLE AS score, CASE WHEN points / 1.5 >= 90 THEN 'A+' WHEN points / 1.5 >= 80 THEN 'A' WHEN points / 1.5 >= 70 THEN 'B' WHEN points / 1.5 >= 60 THEN 'C' ELSE 'D' END AS grade FROM (
         SELECT CAST(10 + 0 + 0 + CASE WHEN 100.0 * 6 / 8 >= 90 THEN 15 WHEN 100.0 * 6 / 8 >= 70 THEN 10 ELSE 0 END + 0 + CASE WHEN off = 0 THEN 20 WHEN off < 5 THEN 15 ELSE 0 END + CASE WHEN lunch = 0 THEN 10 WHEN lunch < 2 THEN 5 ELSE 0 END
          + CASE WHEN we = 0 THEN 15 WHEN we < 10 THEN 10 ELSE 0 END + CASE WHEN v BETWEEN 0.5 AND 2 THEN 15 WHEN v >= 0.3 AND v < 0.5 THEN 10 ELSE 0 END + CASE WHEN sel >= 60 THEN 10 WHEN sel >= 40 THEN 5 ELSE 0 END
          + CASE WHEN len BETWEEN 30 AND 300 THEN 10 ELSE 0 END + CASE WHEN err <= 1 THEN 20 WHEN err <= 5 THEN 15 WHEN err <= 15 THEN 5 ELSE 0 END + CASE WHEN ano <= 15 THEN 15 WHEN ano <= 40 THEN 10 ELSE 0 END AS INTEGER) AS points FROM (
          SELECT avg(CASE WHEN hour("timestamp") >= 20 OR hour("timestamp") <= 6 THEN 100.0 ELSE 0 END) AS off, avg(CASE WHEN hour("timestamp") = 12 THEN 100.0 ELSE 0 END) AS lunch, avg(CASE WHEN isodow("timestamp") >= 6 THEN 100.0 ELSE 0 END) AS we,
           avg(CASE WHEN starts_with(query, 'SELECT') THEN 100.0 ELSE 0 END) AS sel, avg(length(query)) AS len, avg(has_error) * 100 AS err, avg(is_anomaly) * 100 AS ano,
           (SELECT stddev_samp(c) / avg(c) FROM (SELECT count(*) AS c FROM lb GROUP BY "user")) AS v FROM lb))""", rnd={"score": 6})
    add("g11_name_share", lambda sp, sf: G.name_share(labelled(sp, sf), "user_[0-5]"),
        """SELECT count(*) AS users, count_if(regexp_matches(u, 'user_[0-5]'))::BIGINT AS matching, count_if(regexp_matches(u, 'user_[0-5]')) * 100.0::DOUBLE / count(*) AS share FROM (SELECT DISTINCT "user" AS u FROM lb)""", rnd={"share": 6})
    add("g11_expected_databases", lambda sp, sf: G.expected_databases(labelled(sp, sf)),
        f"""SELECT count(DISTINCT "database") AS found, 7 AS expected FROM lb WHERE "database" IN {in_list(G.EXPECTED_DATABASES)}""")
    add("g12_error_report", lambda sp, sf: G.error_report(labelled(sp, sf)),
        """SELECT 'Code ' || CAST(error_code AS VARCHAR) || ': ' || coalesce(error_message, '') AS error, count(*) AS n, arg_min("user" || '@' || "database", event_id) AS who, arg_min(query, event_id) AS query
         FROM lb WHERE error_code <> 0 OR has_error = 1 GROUP BY 1""")

    def errors1146(sp, sf):
        return audit(sp, sf).select(F.lit(1146).alias("error_code"), F.expr("CASE WHEN k % 2 = 0 THEN concat('Table ''shop.t', k % 10, ''' doesn''t exist') ELSE concat('odd ', k % 4) END").alias("error_message"))
    add("g13_missing_tables", lambda sp, sf: G.missing_tables(errors1146(sp, sf)),
        """SELECT CASE WHEN k % 2 = 0 THEN 'shop.t' || CAST(k % 10 AS VARCHAR) ELSE 'Unknown 1146: odd ' || CAST(k % 4 AS VARCHAR) END AS "table", count(*) AS n FROM audit GROUP BY 1""")
    add("g14_clean_rows", lambda sp, sf: G.clean_rows(labelled(sp, sf)).select("event_id", "query"), "SELECT event_id, query FROM lb WHERE has_error <> 1 AND error_code = 0")
    pcfg = RuleConfig(max_query_entropy=6.0)
    cat.add("g15_pool_screen", lambda sp, sf: G.screen_pool(pool(sp, sf), pcfg).select("id", "intent", "reasons", "removed"),
            f"WITH {POOL}, {SCREEN} SELECT id, intent, reasons, reasons <> '' AS removed FROM scr")
    cat.add("g15_screen_summary", lambda sp, sf: G.screen_summary(G.screen_pool(pool(sp, sf), pcfg)),
            f"""WITH {POOL}, {SCREEN} SELECT "database", intent, count(*) AS total, count_if(reasons <> '')::BIGINT AS removed, count_if(reasons = '') * 100.0::DOUBLE / count(*) AS kept_percent FROM scr GROUP BY 1, 2""", rnd={"kept_percent": 6})
    cat.add("g16_pool_stats", lambda sp, sf: G.pool_stats(pool(sp, sf)),
            f"""WITH {POOL} SELECT sum(n)::BIGINT AS total_queries, count(*) AS combinations, count_if(n = 0)::BIGINT AS missing, count_if(n > 0) * 100.0::DOUBLE / count(*) AS coverage_percent FROM (SELECT "database", intent, count(query) AS n FROM pool GROUP BY 1, 2)""", rnd={"coverage_percent": 6})
    cat.add("g16_pool_by_database", lambda sp, sf: G.pool_by_database(pool(sp, sf)), f"""WITH {POOL} SELECT "database", count(DISTINCT intent) AS intents, count(query) AS queries FROM pool GROUP BY 1""")
    cat.add("g16_pool_gaps", lambda sp, sf: G.pool_gaps(pool(sp, sf)), f"""WITH {POOL} SELECT "database", intent FROM pool GROUP BY 1, 2 HAVING count(query) = 0""")
    cat.add("g16_most_used", lambda sp, sf: G.most_used(pool(sp, sf).where("query is not null")),
            f"""WITH {POOL} SELECT "database", intent, query, count(*) AS usage_count FROM pool WHERE query IS NOT NULL GROUP BY 1, 2, 3 ORDER BY usage_count DESC, "database", intent, query LIMIT 10""")
    add("g17_tag_share", lambda sp, sf: G.tag_share(audit(sp, sf).withColumn("query", F.expr("CASE WHEN k % 6 = 0 THEN concat(query, ' /* SIM_META:x */') ELSE query END"))),
        "SELECT count(*) AS total, count_if(k % 6 = 0)::BIGINT AS tagged FROM audit")
