"""Attack, persistence, exfiltration and evasion indicators of monitoring events, and the threats they form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.chains import sessionize
from auditloom.functions.cut import written
from auditloom.functions.joins import measured
from auditloom.functions.once import explode_kept, required_words
from auditloom.functions.segmented import micros
from auditloom.functions.text import normalize_for_detection
from auditloom.monitor import library as L
from auditloom.monitor.risk import capped, matched, score
from auditloom.operators.features import gap_regularity

CONTENT_KEYS = ("query", "query_snippet", "argument")


def detail(key: str) -> Column:
    return F.coalesce(F.col("action_details")[key], F.lit(""))


def off_hours() -> Column:
    h = F.hour("timestamp")
    return (h < 6) | (h > 22)


def remote() -> Column:
    return ~F.col("source_ip").isin(*L.LOCAL_HOSTS)


def found_all(content: Column, regexes: Sequence[str], lowered: Column) -> Column:
    """Distinct pieces of the text that any of the patterns matches."""
    none = F.array().cast("array<string>")
    pieces = []
    for r in regexes:
        cond = None
        for w in required_words(r):
            cond = lowered.contains(w) if cond is None else cond & lowered.contains(w)
        hits = F.regexp_extract_all(content, F.lit(r), F.lit(0))
        pieces.append(hits if cond is None else F.when(cond, hits).otherwise(none))
    return F.array_distinct(F.flatten(F.array(*pieces)))


def content_rows(events: DataFrame) -> DataFrame:
    """One row per event and content field of at least five characters."""
    contents = F.array(*[F.struct(F.lit(k).alias("content_type"), detail(k).alias("content")) for k in CONTENT_KEYS])
    return explode_kept(events, "_c", F.filter(contents, lambda s: F.length(s["content"]) >= 5)).select(*events.columns, "_c.content_type", "_c.content")


def attack_matches(events: DataFrame, library: Sequence[L.AttackPattern] = L.ATTACK_PATTERNS) -> DataFrame:
    """One row per event, content field, pattern and distinct matched piece, for a short list of patterns.

    ``search.attack_matches`` does the same for a table of patterns.
    """
    c = content_rows(events).withColumn("_low", F.lower("content"))
    tries = F.array(*[F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.attack_type).alias("attack_type"),
                               F.lit(p.weight).alias("weight"), found_all(F.col("content"), p.regexes, F.col("_low")).alias("m")) for p in library])
    out = explode_kept(c, "_p", F.filter(tries, lambda p: F.size(p["m"]) > 0))
    out = explode_kept(out, "matched", F.col("_p.m"))
    return out.withColumns({k: F.col("_p")[k] for k in ("pattern_id", "attack_type", "weight")}).drop("_p", "_low")


def attack_indicators(events: DataFrame, account: str, library: Sequence[L.AttackPattern] = L.ATTACK_PATTERNS) -> DataFrame:
    """Matches with their confidence, above the limit of their type."""
    conf = capped(F.round(F.col("weight") + score(
        (F.col("user_account") == account, 0.2), (detail("database").isin(*L.SYSTEM_DATABASES), 0.15), (remote(), 0.1),
        (F.length("matched") > 20, 0.05), (off_hours(), 0.1)), 9))
    limit = F.lit(0.7)
    for t, v in L.CONFIDENCE_LIMITS.items():
        limit = F.when(F.col("attack_type") == t, v).otherwise(limit)
    return attack_matches(events, library).withColumn("confidence", conf).where(F.col("confidence") >= limit)


def mean_confidence() -> Column:
    # Rounded, so that the order of addition cannot move it across a limit.
    return F.round(F.avg("confidence"), 9)


def span(unit_sec: float) -> Column:
    return (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / F.lit(unit_sec * 1e6)


def attack_threats(indicators: DataFrame) -> DataFrame:
    """One threat per attack type, address and account. Pattern ids are a closed set; matched pieces stay in the indicators."""
    g = indicators.groupBy("attack_type", "source_ip", "user_account").agg(
        F.count(F.lit(1)).alias("event_count"), mean_confidence().alias("confidence_score"), span(1).alias("time_span_sec"),
        F.array_sort(F.collect_set("pattern_id")).alias("patterns"), F.max("timestamp").alias("timestamp"))
    base = F.lit("medium")
    for t, s in L.BASE_SEVERITY.items():
        base = F.when(F.col("attack_type") == t, s).otherwise(base)
    c = F.col("confidence_score")
    sev = (F.when((c >= 0.9) & (base == "medium"), "high").when((c >= 0.9) & (base == "high"), "critical")
           .when((c < 0.6) & (base == "critical"), "high").when((c < 0.6) & (base == "high"), "medium").otherwise(base))
    out = g.withColumn("severity", sev)
    acts = F.array(*[F.lit(a) for a in L.BASE_ACTIONS])
    for t, extra in L.TYPE_ACTIONS.items():
        acts = F.when(F.col("attack_type") == t, F.array(*[F.lit(a) for a in (*L.BASE_ACTIONS, *extra)])).otherwise(acts)
    none = F.array().cast("array<string>")
    acts = F.concat(acts, F.when(F.col("severity").isin("high", "critical"), F.array(*[F.lit(a) for a in L.HIGH_ACTIONS])).otherwise(none),
                    F.when(F.col("severity") == "critical", F.array(*[F.lit(a) for a in L.CRITICAL_ACTIONS])).otherwise(none))
    return out.withColumns({"threat_type": F.concat(F.lit("attack_pattern_"), "attack_type"), "response_actions": F.array_sort(acts)})


def attack_sequences(detections: DataFrame, gap_sec: int = 300, min_events: int = 2, now: Column | None = None,
                     timeout_sec: int = 3600) -> DataFrame:
    """Runs of detections of one source and type with pauses up to the gap; each detection counts once."""
    keys = ["source_ip", "user_account", "attack_type"]
    # Detections are few; written once, the pattern matching behind them does not run again.
    slim = written(detections.select(*keys, "timestamp", "event_id", "confidence"))
    runs = sessionize(slim, keys, "timestamp", gap_sec * 1_000_000, ["timestamp", "event_id"])
    out = runs.groupBy(*keys, "session_start").agg(F.count(F.lit(1)).alias("event_count"), F.max("timestamp").alias("end_time"),
                                                   mean_confidence().alias("confidence_score")).where(F.col("event_count") >= min_events)
    if now is None:
        return out
    return out.withColumn("is_active", micros(now) - F.unix_micros("end_time") <= timeout_sec * 1_000_000)


def recent(detections: DataFrame, now: Column, hours: int = 24, attack_type: str | None = None) -> DataFrame:
    out = detections.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return out.where(F.col("attack_type") == attack_type) if attack_type else out


# --- advanced detectors ----------------------------------------------------------------------------------------------
def content() -> Column:
    return F.concat(detail("query"), F.lit(" "), detail("query_snippet"), F.lit(" "), detail("argument"))


def mechanism_matches(events: DataFrame, library: Sequence[L.Mechanism]) -> DataFrame:
    """One row per event, mechanism and pattern that matches its content."""
    c = events.withColumn("content", content()).where(F.length("content") >= 10).withColumn("_low", F.lower("content"))
    low = F.col("_low")
    tries = F.array(*[F.struct(
        F.lit(m.name).alias("mechanism"), F.lit(m.stealth).alias("stealth"),
        (F.size(F.array_compact(F.array(*[F.when(low.contains(w), F.lit(1)) for w in m.words]))) * F.lit(0.1)).alias("words"),
        matched(F.col("content"), m.regexes, low).alias("hits")) for m in library])
    out = explode_kept(c, "_m", F.filter(tries, lambda m: F.size(m["hits"]) > 0))
    out = explode_kept(out, "pattern", F.col("_m.hits"))
    return out.withColumns({k: F.col("_m")[k] for k in ("mechanism", "stealth", "words")}).drop("_m", "_low")


def persistence_indicators(events: DataFrame, account: str, limit: float = 0.85) -> DataFrame:
    user = F.when(F.col("user_account") == account, 0.3).when(F.col("user_account").isin("root", "admin", "administrator"), 0.2).otherwise(0.0)
    conf = capped(F.round(F.lit(0.7) + F.col("stealth") * F.lit(0.2) + user + F.col("words")
                          + score((off_hours(), 0.15), (remote(), 0.1), (F.length("content") > 200, 0.05)), 9))
    return mechanism_matches(events, L.MECHANISMS).withColumn("confidence", conf).where(F.col("confidence") >= limit)


def persistence_threats(indicators: DataFrame, min_indicators: int = 1) -> DataFrame:
    g = indicators.groupBy("mechanism", "source_ip", "user_account").agg(
        F.count(F.lit(1)).alias("indicators_count"), mean_confidence().alias("confidence_score"), span(3600).alias("time_span_hours"),
        F.array_sort(F.collect_set("pattern")).alias("patterns")).where(F.col("indicators_count") >= min_indicators)
    critical = (F.col("confidence_score") >= 0.9) | F.col("mechanism").isin(*L.CRITICAL_MECHANISMS)
    return g.withColumns({"threat_type": F.concat(F.lit("persistence_"), "mechanism"), "severity": F.when(critical, "critical").otherwise("high")})


def exfiltration_indicators(events: DataFrame, account: str, limit: float = 0.6) -> DataFrame:
    n = F.length("content")
    conf = capped(F.round(F.lit(0.6) + F.col("words") + score(
        (n > 1000, 0.2), ((n > 500) & (n <= 1000), 0.1), (off_hours(), 0.15), (F.col("user_account") == account, 0.25), (remote(), 0.15)), 9))
    return (mechanism_matches(events, L.EXFILTRATION).withColumn("confidence", conf).where(F.col("confidence") >= limit)
            .withColumnRenamed("mechanism", "method"))


def volume_anomalies(events: DataFrame, factor: float = 2.5, min_events: int = 5) -> DataFrame:
    """Statements much longer than usual for the account and address."""
    keys = ["user_account", "source_ip"]
    rows = events.withColumn("volume", F.length(detail("query"))).where("volume > 0")
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("_s"))
    j = rows.join(measured(stats.where(F.col("n") >= min_events)), keys)
    dev = (F.col("volume") - F.col("mean_volume")) / F.col("_s")
    return (j.where(F.col("volume") > F.col("mean_volume") + F.lit(factor) * F.col("_s")).withColumn("deviation_factor", dev)
            .withColumn("confidence", F.least(F.lit(0.8), F.lit(0.5) + F.col("deviation_factor") * F.lit(0.1))).drop("_s", "n"))


def timing_anomalies(events: DataFrame, tolerance: float = 0.1, min_ratio: float = 0.8, include_zero_std: bool = False) -> DataFrame:
    keys = ["user_account", "source_ip"]
    reg = gap_regularity(events, keys, tolerance, min_ratio, 10, include_zero_std).where("is_regular")
    last = events.groupBy(*keys).agg(F.max("timestamp").alias("timestamp"))
    return reg.join(last, keys).withColumn("confidence", F.least(F.lit(0.9), F.lit(0.5) + F.col("regularity") * F.lit(0.4)))


def exfiltration_threats(patterns: DataFrame, volumes: DataFrame, timings: DataFrame, account: str) -> DataFrame:
    """Pattern, volume and timing indicators together, per address, account and method."""
    cols = ["source_ip", "user_account", "method", "detection_type", "confidence", "volume", "timestamp"]
    a = patterns.withColumns({"detection_type": F.lit("pattern_based"), "volume": F.lit(0)}).select(*cols)
    b = volumes.withColumns({"method": F.lit("statistical_analysis"), "detection_type": F.lit("volume_anomaly")}).select(*cols)
    c = timings.withColumns({"method": F.lit("regularity_analysis"), "detection_type": F.lit("timing_anomaly"), "volume": F.lit(0)}).select(*cols)
    g = a.unionByName(b).unionByName(c).groupBy("source_ip", "user_account", "method").agg(
        F.count(F.lit(1)).alias("indicators_count"), mean_confidence().alias("confidence_score"), F.sum("volume").alias("total_volume"),
        span(60).alias("time_span_min"), F.array_sort(F.collect_set("detection_type")).alias("detection_types"))
    cs = F.col("confidence_score")
    sev = (F.when((F.col("user_account") == account) | (cs >= 0.9), "critical")
           .when(F.col("method").isin(*L.HIGH_EXFILTRATION) | (cs >= 0.8), "high").otherwise("medium"))
    return g.withColumns({"severity": sev, "threat_type": F.concat(F.lit("exfiltration_"), "method")})


def _behaviour(word: str, c: Column) -> Column:
    """Whether one behavioural sign is present in the content."""
    low = F.lower(c)
    if word == "excessive_whitespace":
        return F.regexp_count(c, F.lit(r"\s")) / F.length(c) > 0.3
    if word == "unusual_comment_patterns":
        return c.rlike(r"(?i)/\*.*?\*/")
    if word == "hex_encoded_strings":
        return c.rlike(r"(?i)0x[0-9a-f]+")
    if word == "string_concatenation_chains":
        return F.regexp_count(c, F.lit(r"(?i)concat\s*\(")) > 2
    if word == "artificial_delays":
        return c.rlike(r"(?i)(?:sleep|waitfor|benchmark)\s*\(")
    if word == "randomized_timing_patterns":
        return low.contains("rand")
    if word == "functionally_equivalent_queries":
        return F.col("is_variation")
    return low.contains(word)


def evasion_indicators(events: DataFrame, account: str, limit: float = 0.6) -> DataFrame:
    """Obfuscation, timing and polymorphism signs. ``is_variation`` (near-duplicate flag) is used if the input has it."""
    if "is_variation" not in events.columns:
        events = events.withColumn("is_variation", F.lit(False))
    c = events.withColumn("content", content()).where(F.length("content") >= 10)
    body = F.col("content")
    tries = []
    for t in L.EVASION:
        obf = sum((F.regexp_count(body, F.lit(_ignore_case(r))) for r in t.regexes[1:]), F.regexp_count(body, F.lit(_ignore_case(t.regexes[0]))))
        beh = sum((F.coalesce(_behaviour(w, body), F.lit(False)).cast("int") for w in t.words[1:]),
                  F.coalesce(_behaviour(t.words[0], body), F.lit(False)).cast("int"))
        tries.append(F.struct(F.lit(t.name).alias("technique"), obf.alias("obfuscation_matches"), beh.alias("behavioral_matches")))
    hits = F.filter(F.array(*tries), lambda t: (t["obfuscation_matches"] > 0) | (t["behavioral_matches"] > 0))
    out = explode_kept(c, "_t", hits).select(*c.columns, "_t.*")
    conf = capped(F.round(F.lit(0.5) + F.least(F.col("obfuscation_matches") * F.lit(0.1), F.lit(0.3))
                          + F.least(F.col("behavioral_matches") * F.lit(0.15), F.lit(0.3))
                          + score((F.col("user_account") == account, 0.2), (off_hours(), 0.1), (F.length("content") > 500, 0.1)), 9))
    return out.withColumn("confidence", conf).where(F.col("confidence") >= limit)


def _ignore_case(r: str) -> str:
    return r if r.startswith("(?i)") else f"(?i){r}"


def evasion_threats(indicators: DataFrame, account: str) -> DataFrame:
    g = indicators.groupBy("technique", "source_ip", "user_account").agg(
        F.count(F.lit(1)).alias("indicators_count"), mean_confidence().alias("confidence_score"),
        F.sum("obfuscation_matches").alias("total_obfuscation"), F.sum("behavioral_matches").alias("total_behavioral"), span(60).alias("time_span_min"))
    sev = (F.when(F.col("user_account") == account, "critical")
           .when((F.col("confidence_score") >= 0.8) | F.col("technique").isin(*L.HIGH_EVASION), "high").otherwise("medium"))
    return g.withColumns({"severity": sev, "threat_type": F.concat(F.lit("evasion_"), "technique")})


# --- statement variations --------------------------------------------------------------------------------------------
def statement_patterns(events: DataFrame) -> DataFrame:
    """How often an account and address sent each normalised statement."""
    return (events.withColumn("normalized", normalize_for_detection(detail("query"))).where(F.length(detail("query")) > 0)
            .groupBy("user_account", "source_ip", "normalized").agg(F.count(F.lit(1)).alias("n")))


def variations(patterns: DataFrame, low: float = 0.7, high: float = 0.95, repeated: int = 1) -> DataFrame:
    """Normalised statements whose words overlap (Jaccard in [low, high)) with another one the key repeated.

    Two sets that similar share a word among the rarest few of each, so only those words are joined
    (with the length bound). It is a semi-join: the similarity is part of its condition and no pairs
    are produced, however many statements resemble each other.
    """
    keys = ["user_account", "source_ip"]
    patterns = written(patterns)
    sets = patterns.withColumn("words", F.array_distinct(F.filter(F.split("normalized", r"\s+"), lambda w: w != ""))).where(F.size("words") > 0)
    rare = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    ranked = (sets.select(*keys, "normalized", F.explode("words").alias("w")).join(rare, "w")
              .groupBy(*keys, "normalized").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda s: s["w"]).alias("ordered")))
    sets = sets.join(ranked, [*keys, "normalized"]).withColumn("size", F.size("words"))
    # Words that must be looked at: size - ceil(low * size) + 1.
    lead = F.slice("ordered", 1, F.col("size") - F.ceil(F.lit(low) * F.col("size") - F.lit(1e-9)).cast("int") + 1)
    probe = sets.select(*keys, "normalized", "words", "size", F.explode(lead).alias("w")).alias("a")
    build = sets.where(F.col("n") > repeated).select(*keys, "words", "size", F.explode(lead).alias("w")).alias("b")
    inter = F.size(F.array_intersect("a.words", "b.words"))
    sim = inter / (F.col("a.size") + F.col("b.size") - inter)
    cond = ((F.col("a.user_account") == F.col("b.user_account")) & (F.col("a.source_ip") == F.col("b.source_ip")) & (F.col("a.w") == F.col("b.w"))
            & (F.col("b.size") >= F.col("a.size") * F.lit(low)) & (F.col("a.size") >= F.col("b.size") * F.lit(low)) & (sim >= low) & (sim < high))
    return probe.join(build, cond, "left_semi").select(*keys, "normalized").distinct()


def mark_variations(events: DataFrame) -> DataFrame:
    """Events with ``is_variation``."""
    e = events.withColumn("normalized", normalize_for_detection(detail("query")))
    hits = variations(statement_patterns(events)).withColumn("is_variation", F.lit(True))
    return e.join(hits, ["user_account", "source_ip", "normalized"], "left").withColumn(
        "is_variation", F.coalesce("is_variation", F.lit(False))).drop("normalized")


# --- pattern feeds ---------------------------------------------------------------------------------------------------
def feed_patterns(feed: DataFrame) -> DataFrame:
    """Threat feed (name, severity, confidence, detection_patterns) to pattern rows, routed by name."""
    name = F.lower("name")
    kind = (F.when(name.contains("credential") | name.contains("dump") | name.contains("shell") | name.contains("backdoor"), "persistence_mechanism")
            .when(name.contains("exfiltration") | name.contains("data"), "exfiltration_pattern").otherwise("evasion_technique"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.7))))
    return feed.where(F.size("detection_patterns") > 0).select(
        "threat_id", "name", kind.alias("update_type"), "severity", conf.alias("confidence"), F.explode("detection_patterns").alias("regex")).where(
        "regex is not null and regex <> ''")


def effectiveness(counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``detection_type``, ``n`` to an effectiveness between 0 and 1."""
    return counts.where("n > 0").withColumn("effectiveness", F.least(F.lit(1.0), F.col("n") / F.lit(10.0))).withColumn(
        "needs_update", F.col("effectiveness") < threshold)
