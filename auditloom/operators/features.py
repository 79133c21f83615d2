"""Per-row and rolling features of the enriched log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.functions.cut import written
from auditloom.functions.segmented import HOUR_US, lag_rows, micros, range_totals, tail_rows, time_slot
from auditloom.functions.joins import measured
from auditloom.functions.quantiles import exact_percentiles
from auditloom.schema import safe_long

FIVE_MINUTES_US = 300_000_000


def preprocess(df: DataFrame) -> DataFrame:
    """Zero-fill the three base metrics, normalise the query, measure the normalised text."""
    q = F.col("query")
    return (df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in
                            ("rows_returned", "rows_affected", "execution_time_ms")})
            .withColumn("normalized_query", text.normalize_query(q))
            .withColumn("query_length", F.length("normalized_query").cast("int")))


def time_features(ts: Column) -> dict[str, Column]:
    hour = F.coalesce(F.hour(ts), F.lit(12))
    weekday = F.coalesce(F.weekday(ts), F.lit(0))
    angle = F.lit(2.0) * F.pi() * hour / F.lit(24.0)
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
            "is_weekend": text.flag(weekday >= 5), "is_late_night": text.flag(hour < 6),
            "is_work_hours": text.flag(hour.between(8, 18))}


def error_features() -> dict[str, Column]:
    count = F.greatest(safe_long(F.col("error_count")), F.lit(0))
    code = safe_long(F.col("error_code"))
    return {"has_error": text.flag((F.col("has_error") > 0) | (count > 0) | (code != 0)),
            "is_access_denied": text.flag(F.lower(F.coalesce("error_message", F.lit(""))).contains("access denied"))}


def command_features(q: Column) -> dict[str, Column]:
    cmd = F.col("command_type")
    two = F.regexp_replace(F.regexp_extract(F.upper(text.strip(q)), r"^(\w+\s+\w+)", 1), r"\s+", " ")
    return {"is_risky_command": text.flag(cmd.isin(*text.RISKY_COMMANDS) | two.isin("CREATE USER", "ALTER USER")),
            "is_admin_command": text.flag(cmd.isin(*text.ADMIN_COMMANDS) | two.isin(*text.ADMIN_COMMANDS)),
            "is_dcl": text.flag(cmd.isin(*text.DCL_COMMANDS) | two.isin(*text.DCL_COMMANDS)),
            "is_ddl": text.flag(cmd.isin(*text.DDL_COMMANDS))}


def publisher_flags(q: Column) -> dict[str, Column]:
    """The simpler flags sent by the log readers: words anywhere in the text."""
    return {"pub_is_admin_command": text.flag(text.upper_has(q, ("GRANT", "REVOKE", "CREATE USER"))),
            "pub_is_risky_command": text.flag(text.upper_has(q, ("DROP", "TRUNCATE"))),
            "pub_has_comment": text.flag(text.contains_any(q, ("--", "/*")))}


def _of_code(q: Column, features) -> dict[str, Column]:
    """Features of the code of a statement, which is told from literals and comments once for all of them."""
    row = F.element_at(F.transform(F.array(text.code(q)), lambda c: F.struct(*[v.alias(k) for k, v in features(c).items()])), 1)
    return {k: row[k] for k in features(q)}


def shape_features(q: Column) -> dict[str, Column]:
    """Structure counts; words in literals, quoted names and comments do not count."""
    return {"num_tables": F.size("accessed_tables").cast("int"), **_of_code(q, lambda c: {
        "num_joins": text.count_of(c, r"(?i)\bJOIN\b"), "num_where_conditions": text.count_of(c, r"(?i)\bWHERE\b"),
        "subquery_depth": text.subquery_depth(c)}), "is_parse_failed": text.parse_failed(q)}


def shape_features_detailed(q: Column) -> dict[str, Column]:
    """The second set of structure counts, by the same rule."""
    return _of_code(q, _detailed)


def _detailed(q: Column) -> dict[str, Column]:
    where = F.regexp_extract(q, r"(?is)\bWHERE\b(.*)", 1)
    has_where = q.rlike(r"(?i)\bWHERE\b")
    return {"num_joins": text.count_of(q, r"(?i)\bJOIN\b"),
            "num_where_conditions": F.when(has_where, text.count_of(where, r"(?i)\b(?:AND|OR)\b") + 1).otherwise(0),
            "num_group_by_cols": text.clause_size(q, "GROUP"), "num_order_by_cols": text.clause_size(q, "ORDER"),
            "has_limit": text.flag(q.rlike(r"(?i)\bLIMIT\b")), "has_subquery": text.flag(q.rlike(r"(?i)\(\s*SELECT\b")),
            "has_union": text.flag(q.rlike(r"(?i)\bUNION\b")), "has_where": text.flag(has_where)}


def access_features(tables: Column) -> dict[str, Column]:
    sensitive = F.array(*[F.lit(t) for t in text.SENSITIVE_TABLES])
    systems = F.array(*[F.lit(s) for s in text.SYSTEM_SCHEMAS])
    return {"is_sensitive_access": text.flag(F.exists(tables, lambda t: F.array_contains(sensitive, t)
                                             | F.array_contains(sensitive, F.substring_index(t, ".", -1)))),
            "is_system_access": text.flag(F.exists(tables, lambda t: t.contains(".")
                                          & F.array_contains(systems, F.substring_index(t, ".", 1)))),
            "accessed_sensitive_tables": F.size(F.filter(tables, lambda t: F.exists(
                sensitive, lambda s: F.contains(t, s)))).cast("int")}


def text_flags(q: Column) -> dict[str, Column]:
    up = F.upper(q)
    return {"has_comment": text.flag(text.contains_any(q, ("--", "/*", "#"))),
            "has_hex": text.flag(up.contains("0X")), "is_select_star": text.flag(up.contains("SELECT *")),
            "has_into_outfile": text.flag(up.contains("INTO OUTFILE")),
            "has_load_data": text.flag(up.contains("LOAD DATA")),
            "has_sleep_benchmark": text.flag(q.rlike(r"(?i)SLEEP\s*\(|BENCHMARK\s*\("))}


def retrieval_speed() -> Column:
    return F.col("rows_returned") / (F.col("execution_time_ms") + F.lit(0.001))


def scan_efficiency() -> Column:
    return F.round(F.col("rows_returned") / (F.col("rows_examined") + F.lit(1)), 6)


def static_features(df: DataFrame) -> DataFrame:
    """Everything that depends on the row alone, in two projections."""
    q = text.strip(F.col("query"))
    first = preprocess(df).withColumns({
        "accessed_tables": text.read_tables(q), "command_type": text.command_type(q),
        "query_entropy": F.coalesce("query_entropy", text.entropy(q)),
        "scan_efficiency": F.coalesce("scan_efficiency", scan_efficiency()),
        "data_retrieval_speed": retrieval_speed(), **time_features(F.col("timestamp")), **error_features(),
        **text_flags(q)})
    detailed = {k: v for k, v in shape_features_detailed(q).items() if k.startswith("has_")}
    return first.withColumns({**shape_features(q), **command_features(q),
                              **access_features(F.col("accessed_tables")), **detailed})


def rolling_5m(df: DataFrame) -> DataFrame:
    """Count, errors, rows and spread of query length over (t - 5 min, t] of the same user."""
    n = F.col("query_length").cast("long")
    out = range_totals(df, ["user"], "timestamp", {
        "query_count_5m": F.lit(1), "error_count_5m": F.col("has_error"), "total_rows_5m": F.col("rows_returned"),
        "_len": n, "_len2": n * n}, before_us=FIVE_MINUTES_US - 1)
    c, s, s2 = F.col("query_count_5m"), F.col("_len"), F.col("_len2")
    # Whole-number sums: n*s2 - s*s cannot go negative by rounding.
    var = (c * s2 - s * s) / (c * (c - 1)).cast("double")
    return out.withColumn("query_len_std_5m", F.when(c > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)).drop(
        "_len", "_len2")


def z_scores(df: DataFrame, metrics=("execution_time_ms", "rows_returned", "data_retrieval_speed"),
             of: DataFrame | None = None) -> DataFrame:
    """Distance from the user's own mean in population standard deviations.

    ``of`` are the same rows before columns were added to them: the statistics then come from a scan of the metrics alone.
    They are a partial aggregate, written and measured: the log is not shuffled for them as long as they are small, and
    beyond that a hot user is split by the adaptive skew join.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"_m_{m}"), F.stddev_pop(m).alias(f"_s_{m}")]
    out = df.join(measured((df if of is None else of).groupBy("user").agg(*aggs)), "user", "left")
    for m in metrics:
        s = F.col(f"_s_{m}")
        out = out.withColumn(f"{m}_zscore", F.when((F.col("_n") < 3) | (s == 0) | s.isNull(), F.lit(0.0)).otherwise(
            (F.col(m) - F.col(f"_m_{m}")) / s))
    return out.drop("_n", *[f"_m_{m}" for m in metrics], *[f"_s_{m}" for m in metrics])


def enrich(df: DataFrame) -> DataFrame:
    """The wide enriched log."""
    rows = static_features(df)
    return z_scores(rolling_5m(rows), of=rows)


def gaps(df: DataFrame, keys, slot_us: int = HOUR_US) -> DataFrame:
    """Seconds since the key's previous event (null for its first)."""
    out = lag_rows(df, keys, ["timestamp", "event_id"], ["timestamp"], time_slot("timestamp", slot_us))
    return out.withColumn("gap_sec", (micros("timestamp") - micros("prev_timestamp")) / F.lit(1e6))


def _slim_gaps(df: DataFrame, keys) -> DataFrame:
    """Gaps alone, written once because their readers go over them several times."""
    return written(gaps(df, keys).where("gap_sec is not null").select(*keys, "gap_sec"))


def gap_summary(df: DataFrame, keys) -> DataFrame:
    g = _slim_gaps(df, keys)
    basic = g.groupBy(*keys).agg(
        F.count("gap_sec").alias("n"), F.avg("gap_sec").alias("mean"), F.stddev_samp("gap_sec").alias("std"),
        F.min("gap_sec").alias("min"), F.max("gap_sec").alias("max"))
    return basic.join(exact_percentiles(g, list(keys), "gap_sec", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), list(keys))


def gap_regularity(df: DataFrame, keys, tolerance: float = 0.1, min_ratio: float = 0.8, min_events: int = 10,
                   include_zero_std: bool = False) -> DataFrame:
    """Share of gaps close to the mean gap; machines are more regular than people.

    A perfectly even series has standard deviation 0 and no gap is *below* 0, so it is not flagged
    unless ``include_zero_std`` is set.
    """
    g = _slim_gaps(df, keys)
    stats = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap_sec").alias("mean_gap"),
                                 F.stddev_samp("gap_sec").alias("std_gap"))
    near = F.abs(F.col("gap_sec") - F.col("mean_gap")) < F.col("std_gap") * F.lit(tolerance)
    if include_zero_std:
        near = near | (F.col("std_gap") == 0)
    return (g.join(stats, list(keys)).groupBy(*keys).agg(
        F.first("n_gaps").alias("n_gaps"), F.first("mean_gap").alias("mean_gap"), F.first("std_gap").alias("std_gap"),
        F.avg(near.cast("double")).alias("regularity"))
        .withColumn("is_regular", (F.col("regularity") > min_ratio) & (F.col("n_gaps") + 1 >= min_events)))


def concurrent_sessions(df: DataFrame, is_connection: Column, keys=("user",), span_us: int = 30_000_000) -> DataFrame:
    """Connection events of the key within +-30 s of each connection event (at least itself)."""
    conn = df.where(is_connection)
    out = range_totals(conn, list(keys), "timestamp", {"concurrent_sessions": F.lit(1)}, span_us, span_us)
    return out.withColumn("concurrent_sessions", F.greatest("concurrent_sessions", F.lit(1).cast("long")))


def sequences(df: DataFrame, features, keys=("user",), length: int = 5, slot_us: int = HOUR_US) -> DataFrame:
    """Rows with the ``length`` latest feature vectors of the key, oldest first; shorter histories are dropped."""
    order, keys = ["timestamp", "event_id"], list(keys)
    base = df.withColumn("_vec", F.array(*[F.col(f).cast("double") for f in features]))
    cut = base.withColumn("_slot", time_slot("timestamp", slot_us))
    w = W.partitionBy(*keys, "_slot").orderBy(*order)
    inner = (cut.withColumn("_near", F.collect_list("_vec").over(w.rowsBetween(-(length - 1), 0)))
             .withColumn("_pos", F.row_number().over(w)))
    tails = tail_rows(cut, keys, order, ["_vec"], length - 1)
    joined = inner.join(tails, [*keys, "_slot"], "left")
    older = F.reverse(F.transform(F.coalesce("_carry", F.array().cast("array<struct<_vec:array<double>>>")),
                                  lambda s: s["_vec"]))
    seq = F.when(F.col("_pos") >= length, F.col("_near")).otherwise(
        F.reverse(F.slice(F.reverse(F.concat(older, F.col("_near"))), 1, length)))
    return (joined.withColumn("sequence", seq).where(F.size("sequence") == length)
            .select(*df.columns, "sequence"))
