"""Read-out queries over stored anomalies and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.onerow import side_by_side
from auditloom.operators import rules as R

# Groups that count as critical, and chart labels.
CRITICAL = ("TECHNICAL_ATTACK", "DATA_DESTRUCTION", "SQL Injection")
GROUP_LABELS = {"TECHNICAL_ATTACK": "Technical Attacks", "INSIDER_THREAT": "Insider Threats",
                "DATA_DESTRUCTION": "Data Destruction", "ACCESS_ANOMALY": "Access Anomalies",
                "MULTI_TABLE_ACCESS": "Mass/Multi-Table", "UNUSUAL_BEHAVIOR": "Behavioral Profile",
                "ML_DETECTED": "AI/ML Detected"}
# Range codes with their length and step.
RANGES = {"D": ("24 HOURS", "hour"), "W": ("7 DAYS", "day"), "M": ("30 DAYS", "day"), "6M": ("180 DAYS", "month"),
          "Y": ("365 DAYS", "month")}


def filter_events(df: DataFrame, user=None, anomaly_type=None, date_from=None, date_to=None, search=None,
                  behavior_group=None) -> DataFrame:
    if user:
        df = df.where(F.col("user") == user)
    if anomaly_type:
        df = df.where(F.col("anomaly_type") == anomaly_type)
    if behavior_group:
        df = df.where(F.col("behavior_group") == behavior_group)
    if date_from:
        df = df.where(F.col("timestamp") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        df = df.where(F.col("timestamp") <= F.lit(date_to).cast("timestamp"))
    if search:
        df = df.where(F.col("query").ilike(f"%{search}%") | F.col("reason").ilike(f"%{search}%"))
    return df


def filter_aggregates(df: DataFrame, user=None, anomaly_type=None, date_from=None, date_to=None, search=None,
                      behavior_group=None) -> DataFrame:
    """Same filters on session anomalies; they all belong to the multi-table group."""
    if behavior_group and behavior_group != R.MULTI_TABLE:
        return df.where(F.lit(False))
    if user:
        df = df.where(F.col("user") == user)
    if anomaly_type:
        df = df.where(F.col("anomaly_type") == anomaly_type)
    if date_from:
        t = F.lit(date_from).cast("timestamp")
        df = df.where((F.col("start_time") >= t) | (F.col("created_at") >= t))
    if date_to:
        t = F.lit(date_to).cast("timestamp")
        df = df.where((F.col("end_time") <= t) | (F.col("created_at") <= t))
    if search:
        df = df.where(F.col("reason").ilike(f"%{search}%") | F.to_json("details").ilike(f"%{search}%"))
    return df


def totals(logs: DataFrame, events: DataFrame, aggregates: DataFrame) -> DataFrame:
    """One row of totals from three counts."""
    n = logs.agg(F.count(F.lit(1)).alias("total_scanned"))
    e = events.agg(F.count(F.lit(1)).alias("_e"), F.count_if(F.col("behavior_group").isin(*CRITICAL)).alias("_ec"))
    a = aggregates.agg(F.count(F.lit(1)).alias("_a"), F.count_if(F.col("anomaly_type").isin(*CRITICAL)).alias("_ac"))
    return side_by_side(n, e, a).select("total_scanned", (F.col("_e") + F.col("_a")).alias("total_anomalies"),
                                              (F.col("_ec") + F.col("_ac")).alias("critical_alerts"))


def time_series(events: DataFrame, aggregates: DataFrame, now: Column, code: str = "D") -> DataFrame:
    """Anomalies per step of the range, empty steps included; keyed by the step's start."""
    span, step = RANGES.get(code, RANGES["D"])
    start = now - F.expr(f"INTERVAL {span}")
    when = events.select(F.col("timestamp").alias("t")).unionByName(aggregates.select(F.col("created_at").alias("t")))
    counts = (when.where((F.col("t") >= start) & (F.col("t") <= now)).groupBy(F.date_trunc(step, "t").alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n")))
    one = events.sparkSession.range(1)
    # The hour chart shows the last 24 hours including the running one.
    first = now - F.expr("INTERVAL 23 HOURS") if step == "hour" else start
    spine = one.select(F.explode(F.sequence(F.date_trunc(step, first), F.date_trunc(step, now),
                                            F.expr(f"INTERVAL 1 {step}"))).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("anomalies"))


def top_risky_users(events: DataFrame, n: int = 10) -> DataFrame:
    return (events.where("user is not null").groupBy("user")
            .agg(F.sum("score").alias("total_score"), F.count(F.lit(1)).alias("violation_count"))
            .orderBy(F.desc("total_score"), "user").limit(n))


def group_distribution(events: DataFrame, aggregates: DataFrame) -> DataFrame:
    label = F.lit("Other")
    for code, text in GROUP_LABELS.items():
        label = F.when(F.col("behavior_group") == code, text).otherwise(label)
    per_group = events.where("behavior_group is not null").groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    sessions = aggregates.agg(F.count(F.lit(1)).alias("value")).where("value > 0").select(
        F.lit(GROUP_LABELS[R.MULTI_TABLE]).alias("name"), "value")
    return per_group.unionByName(sessions).groupBy("name").agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "name")


def top_databases(events: DataFrame, n: int = 5) -> DataFrame:
    return (events.where("database is not null").groupBy(F.col("database").alias("name")).agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), "name").limit(n))


def latest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def kpis(events: DataFrame, aggregates: DataFrame) -> DataFrame:
    names = {"ACCESS_ANOMALY": "access_anomaly", "INSIDER_THREAT": "insider_threat", "TECHNICAL_ATTACK": "technical_attack",
             "DATA_DESTRUCTION": "data_destruction", "ML_DETECTED": "ml_detected", "MULTI_TABLE_ACCESS": "_multi",
             "UNUSUAL_BEHAVIOR": "behavioral_profile"}
    e = events.agg(*[F.count_if(F.col("behavior_group") == g).alias(n) for g, n in names.items()], F.count(F.lit(1)).alias("_all"))
    a = aggregates.agg(F.count(F.lit(1)).alias("_agg"))
    return side_by_side(e, a).withColumns({"multi_table": F.col("_multi") + F.col("_agg"), "total": F.col("_all") + F.col("_agg")}).drop(
        "_multi", "_all", "_agg")


def facets(events: DataFrame, aggregates: DataFrame, behavior_group: str | None = None) -> DataFrame:
    """Distinct users and types that occur, one per row."""
    e = filter_events(events, behavior_group=behavior_group)
    a = filter_aggregates(aggregates, behavior_group=behavior_group)

    def pairs(df: DataFrame) -> DataFrame:
        # Both facets from one scan; the distinct combines before the shuffle.
        return df.select(F.explode(F.array(
            F.struct(F.lit("user").alias("facet"), F.col("user").alias("value")),
            F.struct(F.lit("type").alias("facet"), F.col("anomaly_type").alias("value")))).alias("f")).select("f.*")
    return pairs(e).unionByName(pairs(a)).where("value is not null and value <> ''").distinct()


def unified(events: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Event and session anomalies in one shape."""
    e = events.select(F.concat(F.lit("event-"), F.col("id").cast("string")).alias("id"), F.lit("event").alias("source"),
                      "anomaly_type", "behavior_group", "timestamp", "user", "client_ip", "database", "query", "reason",
                      "score", F.lit("log").alias("scope"), F.lit(None).cast("string").alias("details"))
    a = aggregates.select(F.concat(F.lit("agg-"), F.col("id").cast("string")).alias("id"), F.lit("aggregate").alias("source"),
                          "anomaly_type", F.lit(R.MULTI_TABLE).alias("behavior_group"),
                          F.coalesce("start_time", "end_time", "created_at").alias("timestamp"), "user", "client_ip", "database",
                          F.lit(None).cast("string").alias("query"), "reason", F.col("severity").alias("score"), "scope",
                          F.to_json("details").alias("details"))
    return e.unionByName(a)


def page(df: DataFrame, skip: int, limit: int, order: str = "timestamp") -> DataFrame:
    """A page of the whole ordered result (one top-k of skip + limit rows)."""
    return df.orderBy(F.desc_nulls_last(order), F.desc("id")).offset(skip).limit(limit)


def search(events: DataFrame, aggregates: DataFrame, skip: int = 0, limit: int = 20, **filters) -> DataFrame:
    return page(unified(filter_events(events, **filters), filter_aggregates(aggregates, **filters)), skip, limit)


def search_total(events: DataFrame, aggregates: DataFrame, **filters) -> DataFrame:
    e = filter_events(events, **filters).agg(F.count(F.lit(1)).alias("n"))
    a = filter_aggregates(aggregates, **filters).agg(F.count(F.lit(1)).alias("n"))
    return e.unionByName(a).agg(F.sum("n").alias("total"))


def aggregate_page(aggregates: DataFrame, skip: int, limit: int, **filters) -> DataFrame:
    return (filter_aggregates(aggregates, **filters).orderBy(F.desc_nulls_last("start_time"), F.desc("created_at"), F.desc("id"))
            .offset(skip).limit(limit))


def by_id(df: DataFrame, key: Column) -> DataFrame:
    return df.where(F.col("id") == key)


def explore_logs(logs: DataFrame, search=None, user=None, behavior_group=None, date_from=None, date_to=None,
                 skip: int = 0, limit: int = 100) -> DataFrame:
    if search:
        logs = logs.where(F.col("query").ilike(f"%{search}%"))
    if user:
        logs = logs.where(F.col("user") == user)
    if behavior_group:
        logs = logs.where(F.col("behavior_group") == behavior_group)
    if date_from:
        logs = logs.where(F.col("timestamp") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        logs = logs.where(F.col("timestamp") <= F.lit(date_to).cast("timestamp"))
    return logs.orderBy(F.desc("timestamp"), F.desc("event_id")).offset(skip).limit(limit)


def anomalies_only(logs: DataFrame) -> DataFrame:
    return logs.where(F.coalesce("is_anomaly", F.lit(False)) | (F.coalesce("ml_anomaly_score", F.lit(0.0)) > 0.5))


def trail_alerts(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Newest high-risk entries of an audit trail as alerts."""
    risk = F.coalesce("risk_score", F.lit(0.0))
    hit = entries.where((risk >= 0.7) | (F.col("event_type") == "threat_detection"))
    return hit.orderBy(F.desc("timestamp"), F.desc("entry_id")).limit(limit).select(
        F.col("entry_id").alias("id"), "timestamp", F.when(risk >= 0.9, "critical").otherwise("high").alias("severity"),
        F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))).alias("title"),
        F.coalesce("details", "action_details", F.lit("{}")).alias("description"),
        F.coalesce("component", "target_component", F.lit("unknown")).alias("component"), "risk_score",
        F.lit("new").alias("status"), F.coalesce("user_account", F.lit("system")).alias("affected_users"))


def recent_line_counts(lines: DataFrame, order: str, n: int = 20) -> DataFrame:
    """Errors and warnings among the last lines of a log."""
    last = lines.orderBy(F.desc(order)).limit(n)
    return last.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").contains("ERROR")).alias("errors"),
                    F.count_if(F.col("value").contains("WARNING")).alias("warnings"))
