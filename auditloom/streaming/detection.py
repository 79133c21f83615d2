"""Micro-batch detection that reports at once and corrects later."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions.joins import measured, together
from auditloom.operators import detect as D
from auditloom.operators import rules as R
from auditloom.schema import conform
from auditloom.sources.geo import locate
from auditloom.streaming import habits as H
from auditloom.streaming.batches import before, forget, write_batch, written

FACTS = "kind string, user string, window_start timestamp, value string, n long, first_batch long, last_batch long"
PLACES = "event_id long, user string, client_ip string, timestamp timestamp, at_batch long, jump boolean"
#: State that only the next batch reads.
STATE = ("raw", "checked", "facts", "attackers", "places")


@dataclass
class DetectionJob:
    """Every row is checked and reported in the batch that brings it, with all that is known by then.

    Rules over several rows keep small facts from batch to batch: which addresses and tables a user had in a window, how
    often an address failed in one, the last places of a user. When a later row completes a window, shows that an address
    attacks, or comes between two places, the earlier rows that this concerns are reported again, with their new flags, as
    corrections: an upsert by ``event_id``, the highest ``batch_id`` counts. ``result`` reads the log that way; it is what one
    batch over all rows finds.

    Only a row's own clock says when it happened, and clocks may be wrong. Rows from beyond ``allowance`` after the arrival
    are checked by the rules on single rows and marked ``quarantined``; they take part in no window, and move no clock. Rows
    without a readable time are no audit records (``conform``). Facts go once they are older than ``lateness`` behind the newest time and were not touched for
    ``keep_batches`` batches; a row that comes later still opens its window anew.

    ``settings`` is called for every batch, so changed settings apply without a restart; ``model`` gives the stored model
    that scores rows no rule caught (None: no score); ``habits`` gives the learnt habits before a batch, see ``habits.keep``,
    for which each batch writes what it adds below ``learnt``.
    """

    out: str
    settings: Callable[[], RuleConfig]
    overtime: DataFrame | None = None
    geo_ranges: DataFrame | None = None
    model: Callable[[], PipelineModel | None] | None = None
    habits: Callable[[], DataFrame | None] | None = None
    allowance: dt.timedelta = dt.timedelta(minutes=10)
    lateness: dt.timedelta = dt.timedelta(hours=1)
    keep_batches: int = 1000
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, cfg = batch.sparkSession, self.settings()
        rows = conform(batch)
        odd = F.coalesce(F.unix_micros("timestamp") > int((self.now() + self.allowance).timestamp() * 1e6), F.lit(True))
        write_batch(rows.withColumn("quarantined", odd), f"{self.out}/raw", batch_id)
        rows = spark.read.parquet(f"{self.out}/raw/batch_id={batch_id}")
        good = rows.where("NOT quarantined")
        (windows, hostile), jumps = together(spark, lambda: self._facts(spark, good, cfg, batch_id), lambda: self._places(spark, good, cfg, batch_id))
        known = D.Known(*(windows.where(F.col("kind") == k).select("user", "window_start") for k in ("login", "table")),
                        hostile, jumps.where("jump").select("event_id"))
        logs = self._logs(spark, rows, known, cfg, batch_id)
        fixed = self._corrections(spark, windows.where("fresh"), hostile.where("fresh"), jumps, cfg, batch_id)
        self._report(spark, logs, fixed, cfg, batch_id)
        forget(spark, [f"{self.out}/{s}" for s in STATE], batch_id)

    # --- facts that rules over several rows need ------------------------------------------------------------------

    def _facts(self, spark: SparkSession, good: DataFrame, cfg: RuleConfig, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Windows that are hit and addresses that attack; ``fresh`` if no batch before knew, with the first batch that
        has rows of the window. Facts are distinct per window, and counts are summed, before anything is shuffled."""
        none, hour = F.lit(None).cast("string"), F.window("timestamp", cfg.brute_force_window).getField("start")
        new = good.select(F.lit("login").alias("kind"), "user", D.login_window(cfg).alias("window_start"), F.col("client_ip").alias("value")).distinct() \
            .unionByName(R.multi_table_candidates(good).select(F.lit("table").alias("kind"), "user", D.table_window(cfg).alias("window_start"),
                                                               F.explode("tables").alias("value")).distinct()) \
            .withColumn("n", F.lit(1).cast("long")) \
            .unionByName(good.where("error_code <> 0").groupBy(F.lit("fail").alias("kind"), none.alias("user"), hour.alias("window_start"),
                                                                F.col("client_ip").alias("value")).agg(F.count("*").alias("n")))
        this = F.lit(batch_id).cast("long")
        new = new.select("kind", "user", "window_start", "value", "n", this.alias("first_batch"), this.alias("last_batch"))
        old = before(spark, f"{self.out}/facts", batch_id)
        old = spark.createDataFrame([], FACTS) if old is None else old
        keys = ["kind", "user", "window_start", "value"]
        every = old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"))
        clock = every.agg(F.max("window_start")).scalar()
        stays = (F.col("window_start") >= clock - F.expr(f"INTERVAL {int(self.lateness.total_seconds())} SECONDS")) | (
            F.col("last_batch") > batch_id - self.keep_batches)
        write_batch(every.where(F.coalesce(stays, F.lit(False))), f"{self.out}/facts", batch_id)
        every = spark.read.schema(FACTS).parquet(f"{self.out}/facts/batch_id={batch_id}")
        limits = F.when(F.col("kind") == "login", cfg.concurrent_ips_limit).otherwise(cfg.multi_table_min_count)
        per = every.where("kind <> 'fail'").groupBy("kind", "user", "window_start").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("first_batch") < batch_id, 1)).alias("n_before"), F.min("first_batch").alias("first_batch"))
        windows = per.where(F.col("n") > limits).withColumn("fresh", (F.col("n_before") <= limits) & (F.col("first_batch") < batch_id))
        known = before(spark, f"{self.out}/attackers", batch_id)
        known = spark.createDataFrame([], "client_ip string") if known is None else known.select("client_ip")
        now = every.where((F.col("kind") == "fail") & (F.col("n") > cfg.brute_force_attempts)).select(F.col("value").alias("client_ip")).distinct()
        both = known.withColumn("old", F.lit(True)).unionByName(now.withColumn("old", F.lit(False))).groupBy("client_ip").agg((~F.max("old")).alias("fresh"))
        write_batch(both, f"{self.out}/attackers", batch_id)
        return measured(windows), measured(spark.read.parquet(f"{self.out}/attackers/batch_id={batch_id}"))

    def _places(self, spark: SparkSession, good: DataFrame, cfg: RuleConfig, batch_id: int) -> DataFrame:
        """Located rows of this batch and the recent ones of the same users: event_id, jump, was (before), at_batch."""
        slim = good.select("event_id", "user", "client_ip", "timestamp").withColumns({"at_batch": F.lit(batch_id).cast("long"), "jump": F.lit(None).cast("boolean")})
        old = before(spark, f"{self.out}/places", batch_id)
        old = spark.createDataFrame([], PLACES) if old is None else old
        if self.geo_ranges is None:
            write_batch(old, f"{self.out}/places", batch_id)
            return spark.createDataFrame([], "event_id long, at_batch long, was boolean, jump boolean")
        new = locate(slim, self.geo_ranges).where("lat is not null").drop("lat", "lon")
        users = measured(new.select("user").distinct())
        mine = measured(old.join(users, "user", "left_semi").unionByName(new))
        hits = R.impossible_travel(mine.select("event_id", "user", "client_ip", "timestamp"), self.geo_ranges, cfg).select("event_id", F.lit(True).alias("_hit"))
        # The place before a user's earliest one here is not known any more: what was found of it stays.
        firsts = mine.groupBy("user").agg(F.min(F.struct("timestamp", "event_id"))["event_id"].alias("_first"))
        known = F.when(F.col("event_id") == F.col("_first"), F.col("jump"))
        checked = mine.join(measured(hits), "event_id", "left").join(firsts, "user").withColumn("was", F.col("jump")).withColumn(
            "jump", F.coalesce(known, F.col("_hit"), F.lit(False))).drop("_hit", "_first")
        checked = measured(checked)
        every = checked.drop("was").unionByName(old.join(users, "user", "left_anti"))
        # The last place of every user stays, and places that a late row may still follow.
        last = every.groupBy("user").agg(F.max(F.struct("timestamp", "event_id")).alias("_last"))
        clock = every.agg(F.max("timestamp")).scalar()
        recent = (F.col("timestamp") >= clock - F.expr(f"INTERVAL {int(self.lateness.total_seconds())} SECONDS")) | (F.struct("timestamp", "event_id") == F.col("_last"))
        write_batch(every.join(last, "user").where(recent).select(*old.columns), f"{self.out}/places", batch_id)
        return checked.select("event_id", "at_batch", "was", "jump")

    # --- results -----------------------------------------------------------------------------------------------------

    def _logs(self, spark: SparkSession, rows: DataFrame, known: D.Known, cfg: RuleConfig, batch_id: int) -> DataFrame:
        found = self.habits() if self.habits is not None else None
        profile = spark.createDataFrame([], "user string, hour int, cnt long, last_seen timestamp") if found is None else found
        flags = D.flag_all(rows, cfg, self.overtime, None, known)
        # Windows hold no rows with doubtful times.
        sure = ~F.col("quarantined")
        flags = flags.withColumns({r: F.col(r) & sure for r in ("r01", "r30")})
        det = D.Detection(D.finalize(D.apply_ml(D.apply_profile(D.label_groups(flags), measured(profile), cfg), None), cfg), cfg)
        model = self.model() if self.model is not None else None
        if model is not None:
            from auditloom.operators import ml as M
            write_batch(det.logs, f"{self.out}/checked", batch_id)
            det = M.with_scores(D.Detection(spark.read.parquet(f"{self.out}/checked/batch_id={batch_id}"), cfg), model=model)
        write_batch(det.logs, f"{self.out}/logs", batch_id)
        return spark.read.parquet(f"{self.out}/logs/batch_id={batch_id}")

    def _corrections(self, spark: SparkSession, windows: DataFrame, hostile: DataFrame, jumps: DataFrame, cfg: RuleConfig, batch_id: int) -> DataFrame | None:
        """Earlier rows with new flags. Only batches that have rows of a completed window, or places, are read."""
        if batch_id == 0:
            return None
        turned = jumps.where((F.col("at_batch") < batch_id) & ~F.col("was").eqNullSafe(F.col("jump")))
        firsts = [windows.agg(F.min("first_batch")).first()[0], turned.agg(F.min("at_batch")).first()[0]]
        attacked = hostile.limit(1).count() > 0
        since = 0 if attacked else min((b for b in firsts if b is not None), default=batch_id)
        old = self.logs(spark, since, batch_id)
        if old is None:
            return None
        slim = old.select("event_id", "user", "client_ip", "timestamp", "query", "error_code", "event_name", "quarantined")
        changes = []
        if firsts[0] is not None:
            for kind, rule, start, also in (("login", "r01", D.login_window(cfg), F.lit(True)), ("table", "r30", D.table_window(cfg), D.reads_tables())):
                hit = windows.where(F.col("kind") == kind).select("user", "window_start")
                changes.append(slim.where("NOT quarantined").withColumn("window_start", start).join(hit, ["user", "window_start"], "left_semi").where(also)
                               .select("event_id", F.lit(rule).alias("rule"), F.lit(True).alias("now")))
        if attacked:
            changes.append(slim.where(D.is_connect(cfg)).join(hostile, "client_ip", "left_semi").select("event_id", F.lit("r02").alias("rule"), F.lit(True).alias("now")))
        changes.append(turned.select("event_id", F.lit("r03").alias("rule"), F.col("jump").alias("now")))
        all_ = changes[0]
        for c in changes[1:]:
            all_ = all_.unionByName(c)
        new = measured(all_.groupBy("event_id").agg(*[F.max(F.when(F.col("rule") == r, F.col("now"))).alias(f"_{r}") for r in ("r01", "r02", "r03", "r30")]))
        rows = old.join(new, "event_id")
        differs = F.lit(False)
        for r in ("r01", "r02", "r03", "r30"):
            differs = differs | (F.coalesce(f"_{r}", r) != F.col(r))
        rows = rows.where(differs).withColumns({r: F.coalesce(f"_{r}", r) for r in ("r01", "r02", "r03", "r30")}).drop("_r01", "_r02", "_r03", "_r30", "batch_id")
        rows = D.label_groups(rows).withColumn(f"hit_{R.PROFILE}", D.profile_hit())
        rows = rows.withColumn(f"hit_{R.ML}", F.col(f"hit_{R.ML}") & ~D.caught_by_rule())
        write_batch(D.finalize(rows, cfg), f"{self.out}/corrections", batch_id)
        return spark.read.parquet(f"{self.out}/corrections/batch_id={batch_id}")

    def _report(self, spark: SparkSession, logs: DataFrame, fixed: DataFrame | None, cfg: RuleConfig, batch_id: int) -> None:
        """Anomalies, evidence, lock decisions, alerts, sessions and habits that this batch adds or changes."""
        changed = D.Detection(logs if fixed is None else logs.unionByName(fixed), cfg)
        together(spark, lambda: write_batch(changed.anomalies, f"{self.out}/anomalies", batch_id),
                 lambda: write_batch(changed.session_evidence, f"{self.out}/evidence", batch_id),
                 lambda: write_batch(changed.locks, f"{self.out}/locks", batch_id),
                 lambda: write_batch(changed.alerts, f"{self.out}/alerts", batch_id),
                 lambda: self._sessions(spark, changed, cfg, batch_id),
                 lambda: write_batch(H.learn(logs.where(~F.col(f"hit_{R.TECHNICAL}") & ~F.col("quarantined"))), f"{self.out}/learnt", batch_id))

    def _sessions(self, spark: SparkSession, changed: D.Detection, cfg: RuleConfig, batch_id: int) -> None:
        # A session is reported again, whole, whenever one of its rows is.
        touched = measured(changed.session_evidence.select("user", "session_start").distinct())
        first = spark.read.parquet(f"{self.out}/facts/batch_id={batch_id}").where("kind = 'table'").join(
            touched.select("user", F.col("session_start").alias("_s")), "user").where(
            F.col("window_start").between(F.col("_s") - F.expr("INTERVAL 1 HOUR"), F.col("_s") + F.expr("INTERVAL 1 HOUR"))).agg(F.min("first_batch")).first()[0]
        every = self.logs(spark, batch_id if first is None else first, batch_id + 1)
        whole = every.where(F.col(f"hit_{R.MULTI_TABLE}")).withColumn("session_start", D.session_start(cfg)).join(touched, ["user", "session_start"], "left_semi")
        write_batch(D.session_anomalies(D.multi_table_sessions(whole.drop("session_start"), cfg)), f"{self.out}/sessions", batch_id)

    def logs(self, spark: SparkSession, since: int = 0, until: int | None = None) -> DataFrame | None:
        """The rows of the batches from ``since`` up to but not ``until``, each as corrected last; None if there are none."""
        rows = written(spark, f"{self.out}/logs", since, until)
        fixes = None if rows is None else written(spark, f"{self.out}/corrections", since, until)
        if fixes is None:
            return rows
        last = measured(fixes.groupBy("event_id").agg(F.max("batch_id").alias("batch_id")))
        inside = fixes.join(last, ["event_id", "batch_id"], "left_semi")
        if since:
            inside = inside.join(rows.select("event_id"), "event_id", "left_semi")
        return rows.join(last.select("event_id"), "event_id", "left_anti").unionByName(inside)

    def result(self, spark: SparkSession) -> D.Detection:
        """All rows as known by now."""
        return D.Detection(self.logs(spark).drop("batch_id"), self.settings())
