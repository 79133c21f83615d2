"""Correlation, status, coverage and health of the monitoring itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.onerow import side_by_side
from auditloom.functions.segmented import HOUR_US, lag_rows, recent_rows, time_slot
from auditloom.monitor import library as L


def component_spine(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in L.COMPONENTS])).alias("component"))


def correlations(events: DataFrame) -> DataFrame:
    """Five-minute buckets with several events; read-outs of the newest ones filter the result by time."""
    g = events.groupBy(F.window("timestamp", "5 minutes").getField("start").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("target_component")).alias("components")).where("n_events > 1")
    out = g.withColumn("correlation_score", F.least(F.lit(1.0), F.col("n_events") / F.lit(10.0)))
    return out.withColumns({"correlation_id": F.concat(F.lit("corr_"), F.date_format("bucket", "yyyyMMdd_HHmm")),
                            "risk_assessment": F.when(F.col("correlation_score") > 0.5, "Medium").otherwise("Low")})


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(L.LEVELS):
        out = F.when(c == name, i).otherwise(out)
    return out


def overall_status(threats: DataFrame, health: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row: worst severity, threat count, healthy components, events of the last hour."""
    t = threats.agg(F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0)).alias("_r"), F.count(F.lit(1)).alias("active_threats"))
    h = health.agg(F.count(F.lit(1)).alias("monitored_components"), F.count_if("healthy").alias("healthy_components"))
    e = events.agg(F.count_if((F.col("timestamp") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("timestamp") <= now)).alias("recent_events"))
    level = F.element_at(F.array(*[F.lit(x) for x in L.LEVELS]), F.col("_r") + 1)
    return side_by_side(t, h, e).withColumn("overall_threat_level", level).drop("_r")


def forensic_events(events: DataFrame, start: Column, end: Column, components: Sequence[str] = ()) -> DataFrame:
    """Matching events with the marks of timeline (> 0.5) and evidence (> 0.7)."""
    out = events.where(F.col("timestamp").between(start, end))
    if components:
        out = out.where(F.col("target_component").isin(*components))
    return out.withColumns({"in_timeline": F.col("risk_score") > 0.5, "is_evidence": F.col("risk_score") > 0.7,
                            "summary": F.concat("event_type", F.lit(" on "), "target_component")})


def threats_by_severity(threats: DataFrame) -> DataFrame:
    return threats.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def threats_by_component(threats: DataFrame) -> DataFrame:
    return threats.select(F.explode("affected_components").alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def recent_threats(threats: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    return threats.where(F.col("timestamp") > now - F.expr(f"INTERVAL {hours} HOURS"))


def events_by_component(events: DataFrame) -> DataFrame:
    return events.groupBy("target_component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_score") > 0.7).alias("high_risk"))


def threat_timeline(events: DataFrame, corr: DataFrame) -> DataFrame:
    """High-risk events and correlations in time order."""
    # Types and descriptions.
    e = events.where("risk_score > 0.7").select("timestamp", F.lit("high_risk_event").alias("type"),
        F.concat("event_type", F.lit(" on "), "target_component").alias("description"), F.col("risk_score").alias("score"))
    c = corr.select(F.col("bucket").alias("timestamp"), F.lit("correlation").alias("type"),
        F.concat(F.lit("Correlated activity across "), F.size("components").cast("string"), F.lit(" components")).alias("description"),
        F.col("correlation_score").alias("score"))
    return e.unionByName(c).orderBy("timestamp", "type", "description")


def recommendations(status: DataFrame) -> DataFrame:
    """``status``: one row with overall_status, average_coverage, blind_spots, active_alerts, high_risk_events."""
    # The texts of the recommendations.
    return status.withColumn("recommendations", F.array_compact(F.array(
        F.when(F.col("overall_status") != "healthy", "Investigate and resolve unhealthy monitoring components"),
        F.when(F.col("average_coverage") < 0.8, "Improve monitoring coverage - current average below 80%"),
        F.when(F.col("blind_spots") > 5, F.concat(F.lit("Address "), F.col("blind_spots").cast("string"), F.lit(" identified monitoring blind spots"))),
        F.when(F.col("active_alerts") > 10, "High number of active alerts - review alert rules and thresholds"),
        F.when(F.col("high_risk_events") > 20, "High number of risk events detected - investigate potential security incidents"))))


def emergency_level(threats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Emergency level from the severities (of each group, if ``by`` is given)."""
    s = F.col("severity")
    weight = F.when(s == "critical", 1.0).when(s == "high", 0.7).when(s == "medium", 0.4).when(s == "low", 0.1).otherwise(0.0)
    g = threats.groupBy(*by) if by else threats.groupBy()
    out = g.agg(F.round(F.coalesce(F.sum(weight), F.lit(0.0)), 9).alias("total_score"), F.count_if(s == "critical").alias("critical_count"),
                F.count_if(s == "high").alias("high_count"))
    t, c, h = F.col("total_score"), F.col("critical_count"), F.col("high_count")
    return out.withColumn("level", F.when((c >= 2) | (t >= 0.95), "lockdown").when((c > 0) | (t >= 0.9), "critical")
                          .when((h >= 2) | (t >= 0.7), "high").when((h > 0) | (t >= 0.4), "elevated").otherwise("none"))


def persistent_threats(threats: DataFrame) -> DataFrame:
    """Threats of the same type and indicators, with how often and how long they were seen."""
    sig = F.sha2(F.to_json(F.array_sort(F.map_entries("attack_indicators"))), 256)
    return threats.withColumn("signature", sig).groupBy("threat_type", "signature").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("occurrences")).withColumn(
        "persistence_score", F.round(F.least(F.lit(1.0), F.col("occurrences") * F.lit(0.2)), 9))


def compromise_score(ind: Column) -> Column:
    """Score of a map of indicators."""
    tries = ind["admin_access_attempts"].try_cast("double")
    return F.round(F.least(F.lit(1.0), F.when(F.map_contains_key(ind, F.lit("admin_access_attempts")), F.least(F.lit(0.3), F.coalesce(tries, F.lit(0.0)) * F.lit(0.1))).otherwise(0.0)
                           + F.when(F.map_contains_key(ind, F.lit("credential_indicators")), 0.4).otherwise(0.0)
                           + F.when(F.map_contains_key(ind, F.lit("system_file_modifications")), 0.3).otherwise(0.0)
                           + F.when(F.map_contains_key(ind, F.lit("network_anomalies")), 0.2).otherwise(0.0)), 9)


def coverage(events: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Coverage of every component from its events of the last hour."""
    n = events.where((F.col("timestamp") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("timestamp") <= now)).groupBy(
        F.col("target_component").alias("component")).agg(F.count(F.lit(1)).alias("activity"))
    out = component_spine(events.sparkSession).join(n, "component", "left").withColumn("activity", F.coalesce("activity", F.lit(0).cast("long")))
    a = F.col("activity")
    return out.withColumns({"coverage": F.when(a > 50, 1.0).when(a > 20, 0.8).when(a > 5, 0.5).otherwise(0.1),
                            "status": F.when(a > 50, "full").when(a > 20, "partial").when(a > 5, "minimal").otherwise("none")})


def overall_coverage(cov: DataFrame) -> DataFrame:
    return cov.agg(F.round(F.avg("coverage"), 9).alias("overall_coverage"))


def interaction_patterns(interactions: DataFrame) -> DataFrame:
    """How often and at which hours each (source, target, type) occurs."""
    return interactions.groupBy("source", "target", "type").agg(
        (F.count(F.lit(1)) / F.lit(3600.0)).alias("frequency"), F.array_sort(F.collect_set(F.date_format("timestamp", "HH"))).alias("hours"))


def analysis_gaps(runs: DataFrame, expected_sec: int = 300, slot_us: int = HOUR_US) -> DataFrame:
    """Pauses of more than twice the expected time between the analyses of a server (``server``, ``timestamp``)."""
    seen = lag_rows(runs.withColumn("_at", F.col("timestamp")), ["server"], ["timestamp"], ["_at"], time_slot("timestamp", slot_us))
    gap = (F.unix_micros("timestamp") - F.unix_micros("prev__at")) / F.lit(1e6)
    return seen.select("server", "timestamp", gap.alias("gap_sec")).where(F.col("gap_sec") > 2 * expected_sec).withColumn(
        "gap_percentage", F.least(F.lit(100.0), F.col("gap_sec") / F.lit(3600.0) * F.lit(100.0)))


def blind_spots(cov: DataFrame, interactions: DataFrame, gaps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Component, interaction, behavioural and time blind spots."""
    spark = cov.sparkSession
    low = cov.where(F.col("coverage") < threshold).select(
        F.lit("component").alias("kind"), F.col("component").alias("subject"), F.when(F.col("coverage") < 0.3, "High").otherwise("Medium").alias("risk_level"),
        F.round((F.lit(1.0) - F.col("coverage")) * F.lit(100.0), 9).alias("gap_percentage"))
    expected = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in L.EXPECTED_INTERACTIONS])).alias("p")).select("p.*")
    missing = expected.join(interactions.select("source", "target").distinct(), ["source", "target"], "left_anti").select(
        F.lit("interaction").alias("kind"), F.concat_ws("_", "source", "target").alias("subject"), F.lit("Medium").alias("risk_level"), F.lit(100.0).alias("gap_percentage"))
    seen = interactions.select(F.explode(F.array("source", "target")).alias("component")).distinct()
    silent = cov.where("activity > 0").join(seen, "component", "left_anti").select(
        F.lit("behavioral").alias("kind"), F.col("component").alias("subject"), F.lit("Low").alias("risk_level"), F.lit(50.0).alias("gap_percentage"))
    time = gaps.select(F.lit("temporal").alias("kind"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("subject"), F.lit("Medium").alias("risk_level"), "gap_percentage")
    return low.unionByName(missing).unionByName(silent).unionByName(time)


def system_health(health: DataFrame, events: DataFrame) -> DataFrame:
    """``health``: component, kind ('monitor' or 'detector'), healthy."""
    def ratio(kind: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("healthy").cast("double"))), F.lit(1.0))
    h = health.agg(ratio("monitor").alias("monitor_ratio"), ratio("detector").alias("detector_ratio"))
    m, d = F.col("monitor_ratio"), F.col("detector_ratio")
    status = (F.when((m >= 0.8) & (d >= 0.8), "healthy").when((m >= 0.5) & (d >= 0.5), "warning").when((m > 0) | (d > 0), "critical").otherwise("offline"))
    return side_by_side(h.withColumn("overall_status", status), events.agg(F.max("timestamp").alias("last_event_time")))


def health_checks(checks: DataFrame, keys: Sequence[str] = ("component",), slot_us: int = HOUR_US, last: int = 5) -> DataFrame:
    """Threats from the latest ``last`` checks up to each check (timestamp, is_healthy, response_time_ms, check_id)."""
    keys = list(keys)
    slim = checks.select(*keys, "timestamp", "check_id", F.col("is_healthy").cast("int").alias("_ok"), F.col("response_time_ms").alias("_t"))
    # The earlier checks come as one list per row, which splits by time slot; a null among them leaves the row undecided.
    out = recent_rows(slim, keys, ["timestamp", "check_id"], ["_ok", "_t"], time_slot("timestamp", slot_us), last - 1, "_before")
    oks = sum((F.get("_before", F.lit(i))["_ok"] for i in range(last - 1)), F.col("_ok"))
    mean = sum((F.get("_before", F.lit(i))["_t"] for i in range(last - 1)), F.col("_t")) / F.lit(float(last))
    return out.withColumns({"healthy_count": oks, "avg_response_ms": mean}).where("healthy_count is not null").select(
        *keys, "timestamp", "check_id", "healthy_count", "avg_response_ms",
        F.when(F.col("healthy_count") <= 1, "HIGH").alias("compromise"), F.when(F.col("avg_response_ms") > 5000, "MEDIUM").alias("degradation"))


def health_history(checks: DataFrame) -> DataFrame:
    return checks.groupBy("component", F.when(F.col("is_healthy"), "healthy").otherwise("unhealthy").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_check"))


def rate_degradation(samples: DataFrame, keys: Sequence[str], order: str, value: str, band: int = 10, limit: float = 0.8) -> DataFrame:
    """Mean of the last samples against the ones before; the rank limit keeps two bands per key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    top = samples.withColumn("_r", rank).where(F.col("_r") <= 2 * band)
    g = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_r") <= band, F.col(value))).alias("avg_recent"),
                               F.avg(F.when(F.col("_r") > band, F.col(value))).alias("avg_older"))
    return g.withColumn("degraded", (F.col("_n") >= 2 * band) & (F.col("avg_older") > 0) & (F.col("avg_recent") / F.col("avg_older") < limit)).drop("_n")
