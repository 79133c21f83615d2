"""Data set quality: completeness, activity, distributions, scores and the statement pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions import text
from auditloom.functions.onerow import side_by_side
from auditloom.functions.quantiles import exact_percentiles
from auditloom.operators import rules as R

# Columns a data set must have, and hour bands.
REQUIRED = ("timestamp", "user", "database", "query", "has_error", "is_anomaly")
CORE_HOURS = (8, 9, 10, 11, 13, 14, 15, 16, 17)
EXTENDED_HOURS = (7, 18, 19)
LUNCH_HOURS = (12,)
OFF_HOURS = (20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6)
EXPECTED_DATABASES = ("sales_db", "inventory_db", "finance_db", "marketing_db", "support_db", "hr_db", "admin_db")
# Intents that are attacks, and rules that are noise on other intents.
ATTACK_INTENTS = ("SQL_INJECTION", "DATA_EXFILTRATION", "PRIVILEGE_ESCALATION", "MALICIOUS", "ATTACK", "EXPLOIT")
NOISE_RULES = ("r06", "r19", "r16")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(0.0)


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass, one row per column."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return one.select("_n", F.explode(pairs).alias("p")).select("p.column", "p.nulls", percent(F.col("p.nulls"), F.col("_n")).alias("percent"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, told by 128 bits of hash of all values and null marks; no text is shuffled."""
    own = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in own])
    return df.groupBy(F.xxhash64(*own, nulls), F.xxhash64(F.lit(1), nulls, *own)).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("_c"), F.lit(0)).alias("total"))


def hour_bands(df: DataFrame) -> DataFrame:
    h = F.hour("timestamp")
    n = F.count(F.lit(1))
    bands = {"core": h.isin(*CORE_HOURS), "extended": h.isin(*EXTENDED_HOURS), "lunch": h.isin(*LUNCH_HOURS), "off": h.isin(*OFF_HOURS),
             "weekend": F.weekday("timestamp") >= 5}
    out = df.agg(n.alias("total"), *[F.count_if(c).alias(b) for b, c in bands.items()])
    return out.withColumn("weekday", F.col("total") - F.col("weekend")).withColumns(
        {f"{b}_percent": percent(F.col(b), F.col("total")) for b in bands})


def user_activity(df: DataFrame) -> DataFrame:
    counts = df.groupBy("user").agg(F.count(F.lit(1)).alias("c"))
    basic = counts.agg(F.count(F.lit(1)).alias("users"), F.max("c").alias("most"), F.min("c").alias("least"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"))
    return side_by_side(basic, exact_percentiles(counts, [], "c", {"median": 0.5})).withColumn("variation", F.col("std") / F.col("mean"))


def top_users(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.groupBy("user").agg(F.count(F.lit(1)).alias("queries")).withColumn("share", percent(F.col("queries"), df.agg(F.count(F.lit(1))).scalar()))
            .orderBy(F.desc("queries"), "user").limit(n))


def type_distribution(df: DataFrame) -> DataFrame:
    up = F.upper(text.strip(F.col("query")))
    kind = F.lit("OTHER")
    for v in ("DROP", "CREATE", "DELETE", "UPDATE", "INSERT", "SELECT"):
        kind = F.when(up.startswith(v), v).otherwise(kind)
    return df.where("query is not null").groupBy(kind.alias("query_type")).agg(F.count(F.lit(1)).alias("n"))


def length_summary(df: DataFrame) -> DataFrame:
    q = df.select(F.length("query").alias("len")).where("len is not null")
    basic = q.agg(F.avg("len").alias("mean"), F.max("len").alias("max"), F.min("len").alias("min"))
    return side_by_side(basic, exact_percentiles(q, [], "len", {"median": 0.5}))


def error_rate(df: DataFrame) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("has_error").cast("long")).alias("errors"))
    r = percent(F.col("errors"), F.col("total"))
    return out.withColumn("error_rate", r).withColumn("band", F.when(r <= 1, "EXCELLENT").when(r <= 5, "GOOD").when(r <= 15, "MODERATE").otherwise("HIGH"))


def anomaly_rate(df: DataFrame) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_anomaly").cast("int") == 1).alias("anomalies"))
    r = percent(F.col("anomalies"), F.col("total"))
    return out.withColumn("anomaly_rate", r).withColumn("band", F.when(r <= 2, "CLEAN").when(r <= 15, "NORMAL").when(r <= 40, "HIGH").otherwise("EXTREME"))


def rank_frequency(df: DataFrame, column: str = "user") -> DataFrame:
    """Rank range of each value by its count; values of equal count share the range.

    Ranks are found per distinct count, of which there are at most about the square root of the rows,
    so no window spans the values themselves.
    """
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = c.groupBy("n").agg(F.count(F.lit(1)).alias("_k")).withColumn("rank_to", F.sum("_k").over(w)).withColumn(
        "rank_from", F.col("rank_to") - F.col("_k") + 1)
    return c.join(ranks.drop("_k"), "n").select(column, "n", "rank_from", "rank_to")


def hourly_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def daily_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_anomaly").cast("int") == 1).alias("anomalies"))


def peak_hours(df: DataFrame, n: int = 3) -> DataFrame:
    return hourly_activity(df).orderBy(F.desc("n"), "hour").limit(n)


def database_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("database").agg(F.count(F.lit(1)).alias("n")).withColumn("share", percent(F.col("n"), df.agg(F.count(F.lit(1))).scalar()))


def distinct_counts(df: DataFrame, columns: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """Distinct values per column; with ``relative_error`` from a fixed-size sketch.

    The exact form first reduces each (column, value) to one row, so no task holds a column's values.
    """
    if relative_error is not None:
        one = df.agg(*[F.approx_count_distinct(c, relative_error).alias(c) for c in columns])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("p")).select("p.*")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("n")))


def quality_factors(df: DataFrame, now: Column) -> DataFrame:
    """Completeness, consistency, validity and uniqueness, with their mean and a rating."""
    nulls = null_counts(df).agg(F.sum("nulls").alias("_nulls"))
    rows = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("has_error").cast("long")).alias("_err"), F.count_if(F.col("timestamp") > now).alias("_future"))
    one = side_by_side(nulls, rows, duplicate_count(df))
    n = F.col("_n")
    out = one.select(
        F.greatest(F.lit(0.0), F.lit(100.0) - percent(F.col("_nulls"), n * F.lit(len(df.columns)))).alias("completeness"),
        F.greatest(F.lit(0.0), F.lit(100.0) - percent(F.col("_err"), n)).alias("consistency"),
        F.when(F.col("_future") > 0, 90.0).otherwise(100.0).alias("validity"),
        F.greatest(F.lit(0.0), F.lit(100.0) - percent(F.col("duplicates"), n)).alias("uniqueness"))
    mean = (F.col("completeness") + F.col("consistency") + F.col("validity") + F.col("uniqueness")) / F.lit(4.0)
    return out.withColumn("quality_score", F.round(mean, 9)).withColumn(
        "rating", F.when(F.col("quality_score") >= 90, "Excellent").when(F.col("quality_score") >= 80, "Good").when(F.col("quality_score") >= 70, "Fair").otherwise("Poor"))


def name_share(df: DataFrame, pattern: str) -> DataFrame:
    """Share of distinct users whose name matches the pattern."""
    return df.select("user").distinct().agg(F.count(F.lit(1)).alias("users"), F.count_if(F.lower("user").rlike(pattern)).alias("matching")).withColumn(
        "share", percent(F.col("matching"), F.col("users")))


def expected_databases(df: DataFrame, names: Sequence[str] = EXPECTED_DATABASES) -> DataFrame:
    found = df.select("database").distinct().where(F.col("database").isin(*names)).agg(F.count(F.lit(1)).alias("found"))
    return found.withColumn("expected", F.lit(len(names)))


def _points(*steps: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for cond, p in reversed(steps):
        out = F.when(cond, p).otherwise(out)
    return out


def quality_grade(df: DataFrame, name_pattern: str) -> DataFrame:
    """Points out of 150 from all checks, as a percentage with a grade."""
    m = side_by_side(
        null_counts(df).agg(F.sum("nulls").alias("nulls")), duplicate_count(df).select("duplicates"),
        name_share(df, name_pattern).select(F.col("share").alias("names")), expected_databases(df).select("found"),
        hour_bands(df).select("off_percent", "lunch_percent", "weekend_percent"), user_activity(df).select("variation"),
        type_distribution(df).agg(percent(F.sum(F.when(F.col("query_type") == "SELECT", F.col("n")).otherwise(0)), F.sum("n")).alias("selects")),
        df.agg(F.avg(F.length("query")).alias("mean_length")), error_rate(df).select("error_rate"), anomaly_rate(df).select("anomaly_rate"))
    c = F.col
    points = (F.lit(0 if missing_columns(df) else 10) + _points((c("nulls") == 0, 15)) + _points((c("duplicates") == 0, 10))
              + _points((c("names") >= 90, 15), (c("names") >= 70, 10)) + _points((c("found") >= 5, 15), (c("found") >= 3, 10))
              + _points((c("off_percent") == 0, 20), (c("off_percent") < 5, 15)) + _points((c("lunch_percent") == 0, 10), (c("lunch_percent") < 2, 5))
              + _points((c("weekend_percent") == 0, 15), (c("weekend_percent") < 10, 10))
              + _points((c("variation").between(0.5, 2.0), 15), ((c("variation") >= 0.3) & (c("variation") < 0.5), 10))
              + _points((c("selects") >= 60, 10), (c("selects") >= 40, 5)) + _points((c("mean_length").between(30, 300), 10))
              + _points((c("error_rate") <= 1, 20), (c("error_rate") <= 5, 15), (c("error_rate") <= 15, 5))
              + _points((c("anomaly_rate") <= 15, 15), (c("anomaly_rate") <= 40, 10)))
    out = m.select(points.alias("points")).withColumn("score", F.least(F.col("points") / F.lit(150.0) * F.lit(100.0), F.lit(100.0)))
    s = F.col("score")
    return out.withColumn("grade", F.when(s >= 90, "A+").when(s >= 80, "A").when(s >= 70, "B").when(s >= 60, "C").otherwise("D"))


def is_error() -> Column:
    return (F.coalesce("error_code", F.lit(0)) != 0) | (F.coalesce("has_error", F.lit(0)) == 1)


def error_report(df: DataFrame) -> DataFrame:
    """Errors by code and message with the first example."""
    msg = F.trim(F.coalesce("error_message", F.lit("")))
    g = df.where(is_error()).groupBy(F.concat(F.lit("Code "), F.col("error_code").cast("string"), F.lit(": "), msg).alias("error")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("user", "database", "query"), "event_id").alias("e"))
    return g.select("error", "n", F.concat_ws("@", "e.user", "e.database").alias("who"), F.col("e.query").alias("query")).orderBy(F.desc("n"), "error")


def missing_tables(df: DataFrame) -> DataFrame:
    """Tables that error 1146 names."""
    t = F.regexp_extract("error_message", r"Table '([^']+)' doesn't exist", 1)
    name = F.when(t != "", t).otherwise(F.concat(F.lit("Unknown 1146: "), F.coalesce("error_message", F.lit(""))))
    return df.where("error_code = 1146").groupBy(name.alias("table")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "table")


def clean_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_error())


def tag_share(df: DataFrame, tag: str = "SIM_META") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("query").contains(tag)).alias("tagged"))


# --- statement pool --------------------------------------------------------------------------------------------------
def explode_pool(docs: DataFrame, column: str = "value") -> DataFrame:
    """Pool documents {database: {intent: [statement]}} to rows; an empty intent gives one row without statement."""
    pool = F.from_json(column, "map<string, map<string, array<string>>>")
    other = [c for c in docs.columns if c != column]
    return (docs.select(*other, F.explode(pool).alias("database", "intents")).select(*other, "database", F.explode("intents").alias("intent", "qs"))
            .select(*other, "database", "intent", F.explode_outer("qs").alias("query")))


def screen_pool(pool: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Pool statements with what speaks against them.

    Every statement runs through the noise rules with neutral metrics; attack intents keep all but
    statements at risk of scanning without an index.
    """
    neutral = {"timestamp": F.lit("2024-01-01 12:00:00").cast("timestamp"), "user": F.lit("test_user"), "query_entropy": F.lit(4.5),
               "no_index_used": F.lit(0), "select_full_join": F.lit(0), "rows_examined": F.lit(100)}
    rows = pool.where("query is not null").withColumns(neutral)
    up = F.upper("query")
    scans = (up.contains("SELECT * FROM") | up.contains("LIKE '%")) & (up.contains("FROM") | up.contains("JOIN"))
    attack = text.contains_any(F.upper("intent"), ATTACK_INTENTS)
    noise = F.array_compact(F.array(*[F.when(R.RULE_BY_KEY[k].predicate(cfg) & ~attack, F.lit(R.RULE_BY_KEY[k].label)) for k in NOISE_RULES]))
    reasons = F.concat(F.when(scans, F.array(F.lit("Index Evasion"))).otherwise(F.array().cast("array<string>")), noise)
    return rows.select(*pool.columns, reasons.alias("reasons")).withColumn("removed", F.size("reasons") > 0)


def screen_summary(screened: DataFrame) -> DataFrame:
    return screened.groupBy("database", "intent").agg(F.count(F.lit(1)).alias("total"), F.count_if("removed").alias("removed")).withColumn(
        "kept_percent", percent(F.col("total") - F.col("removed"), F.col("total")))


def pool_stats(pool: DataFrame) -> DataFrame:
    per = pool.groupBy("database", "intent").agg(F.count("query").alias("q"))
    return per.agg(F.sum("q").alias("total_queries"), F.count(F.lit(1)).alias("combinations"), F.count_if(F.col("q") == 0).alias("missing")).withColumn(
        "coverage_percent", percent(F.col("combinations") - F.col("missing"), F.col("combinations")))


def pool_by_database(pool: DataFrame) -> DataFrame:
    return pool.groupBy("database", "intent").agg(F.count("query").alias("q")).groupBy("database").agg(
        F.count(F.lit(1)).alias("intents"), F.sum("q").alias("queries"))


def pool_gaps(pool: DataFrame) -> DataFrame:
    return pool.groupBy("database", "intent").agg(F.count("query").alias("q")).where("q = 0").select("database", "intent")


def most_used(usage: DataFrame, n: int = 10) -> DataFrame:
    return usage.groupBy("database", "intent", "query").agg(F.count(F.lit(1)).alias("usage_count")).orderBy(
        F.desc("usage_count"), "database", "intent", "query").limit(n)
