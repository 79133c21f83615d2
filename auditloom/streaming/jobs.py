"""Structured Streaming jobs. Each batch runs the batch operators; a repeated batch writes the same files again.

Detection is in ``detection``, learnt habits are in ``habits``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.functions.chains import keep_spaced
from auditloom.operators import features as FE
from auditloom.schema import conform
from auditloom.sources import general_log as GL
from auditloom.streaming.batches import before, forget, write_batch, written

WATERMARK = "10 seconds"


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False,
        interval: str = "2 seconds") -> StreamingQuery:
    """Start ``handle`` on every batch. The checkpoint acknowledges a batch only after it returned."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


@dataclass
class RollingJob:
    """Rolling features per batch; the newest rows of the batches before enter, so that no frame is cut at an edge."""

    out: str
    lookback: str = "5 minutes"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = FE.preprocess(conform(batch)).withColumns(FE.error_features())
        write_batch(rows, f"{self.out}/rows", batch_id)
        mine = spark.read.parquet(f"{self.out}/rows/batch_id={batch_id}").withColumn("_own", F.lit(True))
        tail = before(spark, f"{self.out}/tail", batch_id)
        both = mine if tail is None else mine.unionByName(tail.withColumn("_own", F.lit(False)))
        write_batch(FE.rolling_5m(both).where("_own").drop("_own"), f"{self.out}/features", batch_id)
        newest = both.agg(F.max("timestamp")).scalar()
        write_batch(both.where(F.col("timestamp") > newest - F.expr(f"INTERVAL {self.lookback}")).drop("_own"), f"{self.out}/tail", batch_id)
        forget(spark, [f"{self.out}/rows", f"{self.out}/tail"], batch_id)


@dataclass
class LogSessionJob:
    """Text log lines (file, block, pos, value) to statements, with sessions and open statements carried over."""

    out: str
    filter_user: str | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch.select("file", "block", "pos", "value"), f"{self.out}/lines", batch_id)
        lines = spark.read.parquet(f"{self.out}/lines/batch_id={batch_id}")
        sessions = self._last(spark, "sessions", batch_id)
        open_lines = self._last(spark, "open", batch_id)
        if open_lines is not None:
            lines = open_lines.select("file", "block", "pos", "value").unionByName(lines)
        full = lines if sessions is None else GL.state_lines(sessions).unionByName(lines)
        last = (GL.classify_lines(lines).where("kind is not null").groupBy("file")
                .agg(F.max_by(F.struct("block", "pos", "kind"), F.struct("block", "pos")).alias("l")).where("l.kind = 'query'")
                .select("file", F.struct("l.block", "l.pos").alias("_from")))
        waiting = lines.join(last, "file").where(F.struct("block", "pos") >= F.col("_from")).select("file", "block", "pos", "value")
        stmts = GL.parse_general_log(full, self.filter_user)
        ready = stmts.join(last, "file", "left").where(F.col("_from").isNull() | (F.struct("block", "pos") < F.col("_from"))).drop("_from")
        write_batch(ready, f"{self.out}/statements", batch_id)
        write_batch(waiting, f"{self.out}/open", batch_id)
        write_batch(GL.session_state(full, self.filter_user), f"{self.out}/sessions", batch_id)
        forget(spark, [f"{self.out}/{s}" for s in ("lines", "open", "sessions")], batch_id)

    def _last(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        return None if batch_id == 0 else spark.read.parquet(f"{self.out}/{name}/batch_id={batch_id - 1}")

    def finish(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Statements still open after the last batch."""
        open_lines = self._last(spark, "open", batch_id + 1).select("file", "block", "pos", "value")
        state = self._last(spark, "sessions", batch_id + 1)
        return GL.parse_general_log(GL.state_lines(state).unionByName(open_lines), self.filter_user)


def tumbling_counts(stream: DataFrame, minutes: int, delay: str = WATERMARK) -> DataFrame:
    """Events per user and tumbling window; late rows up to the delay still count."""
    return (stream.withWatermark("timestamp", delay).groupBy("user", F.window("timestamp", f"{minutes} minutes"))
            .agg(F.count(F.lit(1)).alias("n")).select("user", F.col("window.start").alias("window_start"), "n"))


def drop_replayed(stream: DataFrame, key: str = "fingerprint", ts: str = "event_ts", delay: str = WATERMARK) -> DataFrame:
    """Each statement once, although overlapping reads deliver it again."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def streaming_sequences(detections: DataFrame, gap: str = "300 seconds", delay: str = WATERMARK, min_events: int = 2) -> DataFrame:
    """Attack sequences as session windows, emitted when the watermark has passed them."""
    return (detections.withWatermark("timestamp", delay)
            .groupBy("source_ip", "user_account", "attack_type", F.session_window("timestamp", gap)).agg(
                F.count(F.lit(1)).alias("event_count"), F.avg("confidence").alias("confidence_score"))
            .where(F.col("event_count") >= min_events)
            .select("source_ip", "user_account", "attack_type", F.col("session_window.start").alias("session_start"), "event_count", "confidence_score"))


@dataclass
class SuppressionJob:
    """Alerts (threat_type, component_key, event_id, timestamp) kept a window apart, across batches.

    The last kept time of each key enters the next batch as its first row, so the batch operator goes
    on where the batch before ended, without a task that holds all rows of a key.
    """

    out: str
    window_sec: int = 300

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, ["threat_type", "component_key"]
        rows = batch.select(*keys, "event_id", "timestamp")
        if batch_id > 0:
            last = spark.read.parquet(f"{self.out}/last/batch_id={batch_id - 1}")
            # Event number -1 marks the carried row and sorts before real rows of its time.
            rows = rows.unionByName(last.withColumn("event_id", F.lit(-1).cast("long")))
        write_batch(rows, f"{self.out}/rows", batch_id)
        mine = spark.read.parquet(f"{self.out}/rows/batch_id={batch_id}")
        kept = keep_spaced(mine, keys, "timestamp", self.window_sec * 1_000_000, tie="event_id")
        write_batch(kept, f"{self.out}/kept", batch_id)
        done = spark.read.parquet(f"{self.out}/kept/batch_id={batch_id}")
        write_batch(done.groupBy(*keys).agg(F.max("timestamp").alias("timestamp")), f"{self.out}/last", batch_id)
        forget(spark, [f"{self.out}/rows", f"{self.out}/last"], batch_id)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return written(spark, f"{self.out}/kept").where("event_id <> -1")
