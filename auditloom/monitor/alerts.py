"""Alerts: creation from threats, suppression, filters, notification and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.chains import keep_spaced
from auditloom.functions.joins import measured
from auditloom.functions.segmented import micros
from auditloom.monitor import library as L

# Priorities by name.
PRIORITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def priority_of(level: Column) -> Column:
    out = F.lit(PRIORITY["medium"])
    for name, n in PRIORITY.items():
        out = F.when(level == name, n).otherwise(out)
    return out


def alerts_from_threats(threats: DataFrame) -> DataFrame:
    """Threats (detection_id, timestamp, threat_type, severity, affected_components, attack_indicators, confidence_score, response_actions)."""
    comps = F.array_join("affected_components", ", ")
    text = F.concat(F.lit("Threat confidence: "), F.format_number("confidence_score", 2), F.lit(". Attack indicators: "),
                    F.array_join(F.map_keys("attack_indicators"), ", "), F.lit(". Recommended actions: "), F.array_join("response_actions", ", "))
    return threats.select(
        F.concat(F.lit("alert_"), F.date_format("timestamp", "yyyyMMdd_HHmmss"), F.lit("_"), F.substring("detection_id", 1, 8)).alias("alert_id"),
        "timestamp", priority_of(F.col("severity")).alias("priority"), F.lit("new").alias("status"),
        F.concat("threat_type", F.lit(" detected on "), comps).alias("title"), text.alias("description"), "threat_type", "severity",
        "affected_components", F.concat(F.array("threat_type", "severity"), "affected_components").alias("tags"))


def component_key() -> Column:
    """Component set as text: order and repeats do not matter."""
    return F.array_join(F.array_sort(F.array_distinct("affected_components")), "|")


def suppress(alerts: DataFrame, window_sec: int = 300) -> DataFrame:
    """Alerts that stay: none of the same type and components was kept in the window before."""
    keyed = alerts.withColumn("_key", component_key())
    return keep_spaced(keyed, ["threat_type", "_key"], "timestamp", window_sec * 1_000_000, tie="detection_id").drop("_key")


def filter_alerts(alerts: DataFrame, priority: str | None = None, status: str | None = None, components=None, tags=None) -> DataFrame:
    if priority:
        alerts = alerts.where(F.col("priority") == PRIORITY[priority])
    if status:
        alerts = alerts.where(F.col("status") == status)
    if components:
        alerts = alerts.where(F.arrays_overlap("affected_components", F.array(*[F.lit(c) for c in components])))
    if tags:
        alerts = alerts.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return alerts


def count_by_priority(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def matching_rules(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Notification rules (rule_id, enabled, min_priority, components, tags) each alert meets; null or empty lists allow all.

    Rules are found by postings: those with components by the components of an alert, those with tags alone by its tags;
    only rules without lists meet all alerts of their priority, which are matches. A pair that shares several entries comes
    once, by the least of them, so nothing has to be made distinct. Rules are broadcast while they are measured to be
    small; beyond that a hot component is split by the adaptive join.
    """
    highest, lowest = max(PRIORITY.values()), min(PRIORITY.values())
    empty = F.array().cast("array<string>")
    live = measured(rules.where(F.col("enabled") & (F.col("min_priority") <= highest)).select(
        "rule_id", F.col("min_priority").alias("_least"), F.coalesce("components", empty).alias("_components"), F.coalesce("tags", empty).alias("_tags")))
    enough = F.col("priority") >= F.col("_least")

    def allowed(wanted: str, own: str) -> Column:
        return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(own, wanted), F.lit(False))

    def posted(own: str, wanted: str, kind: Column) -> DataFrame:
        """Pairs that share an entry of the two lists; ``kind`` says which rules are looked up by it."""
        entries = alerts.withColumn("_entry", F.explode(F.array_distinct(own)))
        return entries.join(live.where(kind).withColumn("_entry", F.explode(F.array_distinct(wanted))), "_entry").where(
            F.col("_entry") == F.array_min(F.array_intersect(own, wanted))).drop("_entry")

    by_component = posted("affected_components", "_components", F.size("_components") > 0).where(enough & allowed("_tags", "tags"))
    by_tag = posted("tags", "_tags", (F.size("_components") == 0) & (F.size("_tags") > 0)).where(enough)
    for_all = alerts.join(live.where((F.size("_components") == 0) & (F.size("_tags") == 0)).withColumn(
        "priority", F.explode(F.sequence(F.greatest(F.col("_least"), F.lit(lowest)), F.lit(highest)))), "priority")
    return by_component.unionByName(by_tag).unionByName(for_all).drop("_components", "_tags", "_least")


def escalations_due(alerts: DataFrame, now: Column, after_min: int = 30, most: int = 3, min_priority: str = "high") -> DataFrame:
    """New alerts (with escalation_count, last_escalation) that waited long enough."""
    wait = after_min * 60_000_000
    return alerts.where(
        (F.col("status") == "new") & (micros(now) - micros("timestamp") >= wait) & (F.col("escalation_count") < most)
        & (F.col("last_escalation").isNull() | (micros(now) - micros("last_escalation") >= wait)) & (F.col("priority") >= PRIORITY[min_priority]))
