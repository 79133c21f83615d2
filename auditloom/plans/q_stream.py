"""Streaming jobs and the learnt score, run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.functions.cut import written
from auditloom.functions.ordinals import coded as coded_by
from auditloom.monitor import library as L
from auditloom.monitor import patterns as P
from auditloom.monitor import search as K
from auditloom.operators import detect as D
from auditloom.operators import features as FE
from auditloom.operators import ml as M
from auditloom.operators import rules as R
from auditloom.plans import sqlbase as S
from auditloom.plans.catalog import Catalog
from auditloom.plans.inputs import CFG, audit, stored
from auditloom.plans.q_monitor import INFRA, MATCHES, SRC, chain_sql, infra
from auditloom.plans.q_status import THREATS, threats
from auditloom.plans.q_tables import STATEMENTS, fresh, ingested, log_lines
from auditloom.sinks.statements import StatementStore
from auditloom.sources.files import stream_text
from auditloom.sources.tail import stream_lines
from auditloom.streaming import habits as H
from auditloom.streaming import jobs as J
from auditloom.streaming.detection import DetectionJob
from auditloom.streaming.windows import WindowCounts

FEEDS = 3


def cuts_of(df, ts: str) -> list:
    """Inner borders of the feeds: thirds of the time range, wherever they fall inside windows."""
    row = df.agg(F.unix_micros(F.min(ts)).alias("a"), F.unix_micros(F.max(ts)).alias("b")).first()
    return [row["a"] + (row["b"] - row["a"]) * k // FEEDS for k in range(1, FEEDS)] if row["a"] is not None else []


def feed(sp, df, ts: str, name: str, start, cuts=None):
    """One range of time after the other: append its rows to the source folder, then let the stream catch up.

    The first and the last range are open, rows without a time come first. ``start`` starts the stream on the source;
    every round resumes from its checkpoint.
    """
    path, us = fresh(sp, name), F.unix_micros(ts)
    df = written(df)  # the borders and every range read it
    edges = [None, *(cuts_of(df, ts) if cuts is None else cuts), None]
    for lo, hi in zip(edges, edges[1:]):
        inside = F.lit(True) if hi is None else F.coalesce(us < hi, F.lit(lo is None))
        df.where(inside if lo is None else inside & (us >= lo)).write.mode("append").parquet(path)
        start(sp.readStream.schema(df.schema).parquet(path)).awaitTermination()


def drain(sp, df, ts: str, job, name: str):
    """Run a batch job over the fed rows."""
    ckpt = fresh(sp, f"{name}-ckpt")
    feed(sp, df, ts, f"{name}-in", lambda stream: J.run(stream, job, ckpt, available_now=True))


def collect_stream(sp, df, ts: str, transform, name: str, cuts=None):
    """Run an append stream over the fed rows and read what it wrote."""
    out, ckpt = fresh(sp, f"{name}-out"), fresh(sp, f"{name}-ckpt")
    feed(sp, df, ts, f"{name}-in", lambda stream: transform(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", ckpt).trigger(availableNow=True).start(), cuts)
    return sp.read.parquet(out)


def register(cat: Catalog) -> None:
    _streams(cat)
    _ml(cat)


def detected_stream(sp, sf):
    """The log as the stream reported and corrected it."""
    job = DetectionJob(fresh(sp, "stream-detect"), lambda: CFG, X.overtime(sp, sf), X.geo_ranges(sp, sf))
    drain(sp, X.audit_log_raw(sp, sf), "timestamp", job, "detect")
    return job.logs(sp)


def _streams(cat: Catalog) -> None:
    keys = [f"r{k:02d}" for k in range(1, 31)]
    cat.add("x01_micro_batch_detection", lambda sp, sf: detected_stream(sp, sf).select("event_id", F.concat_ws(";", *[F.when(F.col(r), r) for r in keys]).alias("hits")),
            S.sql("flags", "SELECT event_id, concat_ws(';', " + ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in keys) + ") AS hits FROM flags"))
    for minutes in (1, 4, 5):
        cat.add(f"x02_tumbling_{minutes}m", lambda sp, sf, m=minutes: collect_stream(sp, audit(sp, sf), "timestamp", lambda s: J.tumbling_counts(s, m), "tumble"),
                S.sql("audit", f"""SELECT "user", time_bucket(INTERVAL {minutes} MINUTE, "timestamp") AS window_start, count(*) AS n FROM audit GROUP BY 1, 2
                 HAVING time_bucket(INTERVAL {minutes} MINUTE, min("timestamp")) + INTERVAL {minutes} MINUTE <= date_trunc('millisecond', (SELECT max("timestamp") FROM audit) - INTERVAL 10 SECOND)"""), ts=("window_start",))

    def rolling(sp, sf):
        out = fresh(sp, "stream-rolling")
        drain(sp, X.audit_log_raw(sp, sf), "timestamp", J.RollingJob(out), "rolling")
        return J.written(sp, f"{out}/features")
    cat.add("x03_rolling_lookback", lambda sp, sf: rolling(sp, sf).select("event_id", "query_count_5m", "total_rows_5m"),
            S.sql("audit", """SELECT event_id, count(*) OVER w AS query_count_5m, sum(rows_returned) OVER w AS total_rows_5m FROM audit
             WINDOW w AS (PARTITION BY "user" ORDER BY epoch_us("timestamp") RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)"""), big=("total_rows_5m",))

    def learnt(sp, sf):
        """Habits kept by the engine from what each batch of detection adds."""
        job, state = DetectionJob(fresh(sp, "stream-profile"), lambda: CFG), fresh(sp, "habits-ckpt")

        def learning(batch, batch_id):
            job(batch, batch_id)
            H.keep(sp, f"{job.out}/learnt", state, CFG.profile_ttl_days, available_now=True).awaitTermination()
        drain(sp, X.audit_log_raw(sp, sf), "timestamp", learning, "profile")
        newest = audit(sp, sf).agg(F.max("timestamp")).scalar()
        return H.habits(sp, state, newest, CFG.profile_ttl_days)
    cat.add("x04_profile_state", learnt, S.sql("det", """SELECT "user", hour("timestamp") AS hour, count(*) AS cnt, max("timestamp") AS last_seen FROM det WHERE NOT h_tec GROUP BY 1, 2
             QUALIFY max(max("timestamp")) OVER (PARTITION BY "user") > (SELECT max("timestamp") FROM audit) - INTERVAL 30 DAY"""), ts=("last_seen",), ints=("hour",))

    def sessions(sp, sf):
        out = fresh(sp, "stream-lines")
        lines = log_lines(sp, sf).withColumn("at", F.timestamp_micros(F.floor(F.col("pos") / 10)))
        job = J.LogSessionJob(out, "user_7")
        drain(sp, lines, "at", job, "lines")
        done = J.written(sp, f"{out}/statements").drop("batch_id")
        return done.unionByName(job.finish(sp, FEEDS - 1))
    cat.add("x05_log_sessions", lambda sp, sf: sessions(sp, sf).select("timestamp", "user", "client_ip", "database", "query", "thread"),
            cat.items["s11_general_log_text"].sql)
    cat.add("x06_replay_dedup", lambda sp, sf: collect_stream(sp, ingested(sp, sf).unionByName(ingested(sp, sf).where("event_id % 3 = 0")).select(
        "event_id", "event_ts", "fingerprint"), "event_ts", J.drop_replayed, "dedup").select("event_id", "fingerprint"),
        S.sql("audit", "SELECT event_id, fingerprint FROM st", STATEMENTS))

    def discovered(sp, sf):
        """Text files that arrive in two rounds; the checkpoint lets every line be read once."""
        path, out, ckpt = fresh(sp, "files-in"), fresh(sp, "files-out"), fresh(sp, "files-ckpt")
        rows = audit(sp, sf).select(F.concat_ws(" ", F.col("event_id").cast("string"), "query").alias("value"), "event_id")
        for part in (0, 1):
            rows.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(path)
            stream_text(sp, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(
                availableNow=True).start().awaitTermination()
        return sp.read.parquet(out)
    def stored_once(sp, sf):
        """A feed that delivers a third of its statements again, each round into the store; what it holds at the end."""
        store, stamped = StatementStore(fresh(sp, "statements")), written(ingested(sp, sf).select("event_id", "event_ts", "fingerprint"))
        drain(sp, stamped.unionByName(stamped.where("event_id % 3 = 0")), "event_ts", lambda batch, _: store.insert(batch), "insert")
        drain(sp, stamped.where("event_id % 2 = 0").withColumn("event_id", -F.col("event_id")), "event_ts", lambda batch, _: store.insert(batch), "again")
        return store.rows(sp).select("event_id", "fingerprint")
    cat.add("x06_insert_ignore", stored_once, S.sql("audit", "SELECT event_id, fingerprint FROM st", STATEMENTS))

    def grown_files(sp, sf):
        """Eight log files that grow in four rounds and are renamed before the third; every line, with its place, once."""
        into, out, ckpt = fresh(sp, "grown-in"), fresh(sp, "grown-out"), fresh(sp, "grown-ckpt")
        jvm = sp._jvm
        at = jvm.org.apache.hadoop.fs.Path
        fs = at(into).getFileSystem(sp._jsc.hadoopConfiguration())
        fs.mkdirs(at(into))
        rows = audit(sp, sf).select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), F.translate("query", "\r\n", "  ")).alias("value"),
                                    (F.col("event_id") % 8).alias("f"), (F.floor(F.col("event_id") / 8) % 4).alias("part"))
        for k, have in enumerate(([0], [0, 1], [2], [2, 3])):
            made = fresh(sp, "grown-made")
            rows.where(F.col("part").isin(have)).repartition(8, "f").sortWithinPartitions("f", "part", "event_id").select("value", "f").write.partitionBy("f").text(made)
            for f in range(8):
                live = at(f"{into}/{f}.log")
                if k == 2 and fs.exists(live):
                    fs.rename(live, at(f"{into}/{f}.log.1"))
                for part in fs.globStatus(at(f"{made}/f={f}/part-*")) or []:
                    fs.delete(live, False)
                    fs.rename(part.getPath(), live)
            stream_lines(sp, into).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        return sp.read.parquet(out).select(F.regexp_extract("file", r"(\d+\.log)", 1).alias("file"), "pos", "value")
    cat.add("s13_growing_files", grown_files, S.sql("audit", """SELECT file, CAST(coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file, part // 2 ORDER BY part, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, value FROM (SELECT event_id, CAST(event_id % 8 AS VARCHAR) || '.log' AS file, event_id // 8 % 4 AS part,
             CAST(event_id AS VARCHAR) || ' ' || translate(query, chr(13) || chr(10), '  ') AS value FROM audit)"""))
    cat.add("s13_incremental_files", discovered, S.sql("audit", "SELECT CAST(event_id AS VARCHAR) || ' ' || query AS value FROM audit"))

    def late(sp, sf):
        """The last feed also brings rows five seconds older than the feed before it, and rows days older."""
        a = audit(sp, sf).select("event_id", "timestamp", "user")
        newest = a.where("timestamp < '2024-01-11'").agg(F.max("timestamp")).scalar()
        second = a.where("timestamp >= '2024-01-11'")
        tardy = second.where("event_id % 7 = 0").withColumn("timestamp", newest - F.expr("INTERVAL 5 SECONDS"))
        lost = second.where("event_id % 7 = 1").withColumn("timestamp", newest - F.expr("INTERVAL 8 DAYS"))
        feeds = a.withColumn("fed", F.col("timestamp")).unionByName(tardy.unionByName(lost).withColumn("fed", F.lit("2024-01-12").cast("timestamp")))
        job, ckpt = WindowCounts(fresh(sp, "late-out")), fresh(sp, "late-ckpt")
        borders = [d * 86_400_000_000 + 1_704_067_200_000_000 for d in (5, 10)]  # 6 and 11 January 2024
        feed(sp, feeds, "fed", "late-in", lambda stream: J.run(stream, job, ckpt, available_now=True), borders)
        return job.windows(sp)
    cat.add("x07_late_data", late,
            S.sql("audit", """SELECT "user", time_bucket(INTERVAL 5 MINUTE, t) AS window_start, count(*) AS n, CAST(sum(late) AS BIGINT) AS late FROM rows GROUP BY 1, 2""",
                  """m AS (SELECT max("timestamp") AS t FROM audit WHERE "timestamp" < TIMESTAMP '2024-01-11'),
                  rows AS (SELECT "user", "timestamp" AS t, 0 AS late FROM audit
                   UNION ALL SELECT "user", (SELECT t FROM m) - INTERVAL 5 SECOND, 0 FROM audit WHERE "timestamp" >= TIMESTAMP '2024-01-11' AND event_id % 7 = 0
                   UNION ALL SELECT "user", (SELECT t FROM m) - INTERVAL 8 DAY, 1 FROM audit WHERE "timestamp" >= TIMESTAMP '2024-01-11' AND event_id % 7 = 1)"""), ts=("window_start",))

    def suppressed(sp, sf):
        from auditloom.monitor.alerts import component_key
        t = threats(sp, sf).select("threat_type", component_key().alias("component_key"), "event_id", "timestamp")
        job = J.SuppressionJob(fresh(sp, "stream-alerts"), 43_200)
        drain(sp, t, "timestamp", job, "alerts")
        return job.alerts(sp)
    cat.add("l02_suppression_stream", lambda sp, sf: suppressed(sp, sf).select("event_id", "threat_type"),
            chain_sql("audit", [THREATS, """al AS (SELECT *, threat_type || '|' || array_to_string(list_sort(comps), '|') AS key FROM thr)"""], "event_id, threat_type", 43_200_000_000))

    def extra(sp, sf):
        """A pattern table derived from the nations: new patterns, and two of the library with another weight or expression."""
        return X.read_table(sp, sf, "nation").selectExpr(
            "CASE n_nationkey WHEN 0 THEN 'privesc_003' WHEN 1 THEN 'lateral_001' ELSE concat('dyn_', n_nationkey) END AS pattern_id",
            "'sql_injection' AS attack_type", "0.75D AS weight", "CASE n_nationkey WHEN 0 THEN '(?i)set\\\\s+global' ELSE concat('(?i)id = ', n_nationkey, '\\\\d') END AS regex")

    def updated(sp, sf):
        return K.attack_matches(P.content_rows(infra(sp, sf)), K.merged_library(K.library_table(sp, L.ATTACK_PATTERNS), extra(sp, sf)))
    cat.add("p01_pattern_update", lambda sp, sf: updated(sp, sf).select("event_id", "content_type", "pattern_id", "attack_type", "weight", "matched"),
            S.sql("audit", r"""SELECT event_id, content_type, pattern_id, attack_type, weight, matched FROM matches WHERE pattern_id NOT IN ('privesc_003', 'lateral_001')
             UNION ALL SELECT DISTINCT event_id, content_type, pid, 'sql_injection', 0.75::DOUBLE, unnest(list_distinct(regexp_extract_all(c, rx))) FROM src JOIN extra ON regexp_matches(c, rx)""", INFRA, SRC, MATCHES,
                  r"""extra AS (SELECT CASE n_nationkey WHEN 0 THEN 'privesc_003' WHEN 1 THEN 'lateral_001' ELSE 'dyn_' || CAST(n_nationkey AS VARCHAR) END AS pid,
                   CASE n_nationkey WHEN 0 THEN '(?i)set\s+global' ELSE '(?i)id = ' || CAST(n_nationkey AS VARCHAR) || '\d' END AS rx FROM nation)"""), rnd={"weight": 6})

    def reconfigured(sp, sf):
        from auditloom.operators import rules as R
        cfg = CFG.merged({"security_rules": {"thresholds": {"execution_time_limit_ms": 20000}, "signatures": {"sqli_keywords": ["JSON_EXTRACT"]}}})
        return R.with_row_rules(R.with_entropy(audit(sp, sf)), cfg).where("r11 or r12").select("event_id", "r11", "r12")
    cat.add("p01_settings_update", reconfigured, S.sql("audit", """SELECT event_id, contains(upper(query), 'JSON_EXTRACT') AS r11, execution_time_ms > 20000 AS r12 FROM audit
        WHERE contains(upper(query), 'JSON_EXTRACT') OR execution_time_ms > 20000"""))


# --- learnt score ----------------------------------------------------------------------------------------------------
NUMERIC = ("execution_time_ms", "rows_returned", "rows_examined", "lock_time_ms")


def enriched(sp, sf):
    return FE.static_features(audit(sp, sf)).select("event_id", "timestamp", "user", "client_ip", "database", "command_type", *NUMERIC, "query_length", "hour_sin", "hour_cos")


_models: dict[tuple[str, str], str] = {}


_features: dict[tuple[str, str], DataFrame] = {}


def features(sp, sf):
    """The features of every row, written once per session: training and every score read them."""
    key = (sp.sparkContext.applicationId, sf)
    if key not in _features:
        rows = FE.enrich(audit(sp, sf))
        num, cats = M.feature_columns(rows)
        kept = {"event_id", "timestamp", *num, *cats}
        _features[key] = written(rows.select(*[c for c in rows.columns if c in kept]))
    return _features[key]


def trained(sp, sf):
    """The model of the newest rows, trained once per session and read from its stored form."""
    key = (sp.sparkContext.applicationId, sf)
    if key not in _models:
        path = fresh(sp, "models")
        rows = features(sp, sf)
        model = M.train(M.training_buffer(rows))
        num, cats = M.feature_columns(rows)
        _models[key] = f"{path}|{M.save_model(model, sp, path, [*num, *cats], '20240130')}"
    return M.load_model(*_models[key].split("|"))


def _ml(cat: Catalog) -> None:
    cat.add("m01_training_buffer", lambda sp, sf: M.training_buffer(audit(sp, sf)).select("event_id", "user"),
            S.sql("audit", 'SELECT event_id, "user" FROM audit ORDER BY "timestamp" DESC, event_id DESC LIMIT 5000'))

    def chosen(sp, sf):
        e = enriched(sp, sf)
        num, cats = M.feature_columns(e)
        return e.groupBy().agg(F.count(F.lit(1)).alias("total")).withColumns({"numeric": F.lit(",".join(num)), "categorical": F.lit(",".join(cats))})
    cat.add("m02_feature_columns", chosen, "SELECT count(*) AS total, 'execution_time_ms,rows_returned,rows_examined,lock_time_ms,query_length,hour_sin,hour_cos' AS numeric, 'user,client_ip,database,command_type' AS categorical FROM events")

    def coded(sp, sf):
        a = audit(sp, sf)
        known = a.where("user <> 'user_7'")
        return coded_by(coded_by(a.select("event_id", "user", "database"), known, "user"), known, "database").select("event_id", "user_code", "database_code")
    cat.add("m03_category_codes", coded, S.sql("audit", """SELECT event_id, CAST(substr("user", 6) AS DOUBLE) AS user_code, CASE "database" WHEN 'hr_db' THEN 0.0::DOUBLE WHEN 'mysql' THEN 1.0 ELSE 2.0 END AS database_code FROM audit"""))
    cat.add("m04_standardize", lambda sp, sf: M.standardize(audit(sp, sf), M.scaling(audit(sp, sf), NUMERIC)).select("event_id", *[f"{c}_std" for c in NUMERIC]),
            S.sql("audit", "SELECT event_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}_std" for c in NUMERIC) + " FROM audit"), rnd={f"{c}_std": 4 for c in NUMERIC})
    cat.add("m05_pseudo_labels", lambda sp, sf: M.reconstruction_labels(audit(sp, sf), NUMERIC).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
            S.sql("audit", """SELECT label, count(*) AS n FROM (SELECT CASE WHEN r <= (SELECT count(*) - 1 - floor(0.961 * (count(*) - 1)) FROM s WHERE p >= 5) AND p >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM (
             SELECT *, row_number() OVER (PARTITION BY p >= 5 ORDER BY event_id) AS r FROM s)) GROUP BY 1""", 's AS (SELECT event_id, row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", event_id) AS p FROM audit)'))
    cat.add("m06_supervised_score", lambda sp, sf: M.score(trained(sp, sf), features(sp, sf)).select("event_id", F.col("ml_anomaly_score").between(0, 1).alias("scored")),
            S.sql("audit", "SELECT event_id, true AS scored FROM audit"))

    def learnt_hits(sp, sf):
        """Every log row with what the learnt score may say of it: nothing of rows that a rule caught, or with too few rows."""
        done = stored(sp, sf).logs
        by_rule, hit = D.caught_by_rule(), F.col(f"hit_{R.ML}")
        return done.select("event_id", by_rule.alias("by_rule"), (~hit | (~by_rule & (F.col("ml_anomaly_score") >= 0.75))).alias("sound"),
                           (F.col("unusual_activity_reason").isNotNull() == (by_rule | hit)).alias("reasoned"),
                           F.col("ml_anomaly_score").isNotNull().alias("scored"))
    cat.add("k02_learnt_set", learnt_hits, S.sql("det", "SELECT event_id, by_rule, true AS sound, true AS reasoned, NOT by_rule AND count(*) FILTER (NOT by_rule) OVER () >= 100 AS scored FROM caught",
        "caught AS (SELECT event_id, (h_acc OR h_ins OR h_tec OR h_des OR h_mul OR h_pro) AS by_rule FROM det)"))

    def flagged(sp, sf):
        return M.flag_scores(audit(sp, sf).select("event_id", (F.col("value") / F.lit(600.0)).alias("ml_anomaly_score")))
    cat.add("m07_dynamic_threshold", lambda sp, sf: flagged(sp, sf), S.sql("audit", """SELECT event_id, value / 600.0::DOUBLE AS ml_anomaly_score, value / 600.0::DOUBLE >= greatest((SELECT quantile_cont(value / 600.0::DOUBLE, 0.99) FROM audit), 0.75) AS is_ml FROM audit"""),
            rnd={"ml_anomaly_score": 6})

    def saved(sp, sf):
        """Rows whose score differs between the model in memory and the one read back."""
        rows, path = features(sp, sf), fresh(sp, "models")
        model = trained(sp, sf)
        num, cats = M.feature_columns(rows)
        again = M.load_model(path, M.save_model(model, sp, path, [*num, *cats], "20240130"))
        both = M.score(model, rows).select("event_id", F.col("ml_anomaly_score").alias("a")).join(
            M.score(again, rows).select("event_id", F.col("ml_anomaly_score").alias("b")), "event_id")
        return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))
    cat.add("m08_saved_model", saved, S.sql("audit", "SELECT count(*) AS n, 0::BIGINT AS different FROM audit"))
