"""Habits (user, hour of day, count) as keyed state that the engine keeps and expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from auditloom.operators.rules import learn_profile

LEARNT = "user string, hour int, cnt bigint, last_seen timestamp, batch_id bigint"
CHANGES = "user string, hour int, cnt bigint, seen_us bigint, forgotten boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HabitState(StatefulProcessor):
    """Per user a map from hours to counts; a timer forgets a user who was not seen for the whole TTL.

    Input is one row per user, hour and batch, summed before it arrives, so a busy user is 24 rows a batch and not
    one task with all statements. A batch that is delivered again is known by its number and changes nothing.
    """

    def __init__(self, ttl_days: int):
        self.ttl_us = ttl_days * 86_400_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour int", "cnt bigint, seen_us bigint, batch_id bigint")
        self.seen = handle.getValueState("seen", "seen_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.seen.get()[0] if self.seen.exists() else None
        for r in sorted(rows, key=lambda r: r.batch_id):
            cnt, at, batch = self.hours.getValue((r.hour,)) if self.hours.containsKey((r.hour,)) else (0, r.seen_us, -1)
            if r.batch_id <= batch:
                continue
            at = max(at, r.seen_us)
            self.hours.updateValue((r.hour,), (cnt + r.cnt, at, r.batch_id))
            last = at if last is None else max(last, at)
            yield Row(user=key[0], hour=r.hour, cnt=cnt + r.cnt, seen_us=at, forgotten=False)
        if last is not None:
            self.seen.update((last,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last + self.ttl_us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.seen.get()[0]
        for hour in [h[0] for h in self.hours.keys()]:
            yield Row(user=key[0], hour=hour, cnt=0, seen_us=last, forgotten=True)
        self.hours.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def changes(learnt: DataFrame, ttl_days: int, delay: str = "0 seconds") -> DataFrame:
    """Habits that changed or were forgotten, from a stream of (user, hour, cnt, last_seen, batch_id)."""
    # Times in state are whole microseconds, which no zone can shift.
    return learnt.withColumn("seen_us", F.unix_micros("last_seen")).withWatermark("last_seen", delay).groupBy("user").transformWithState(
        HabitState(ttl_days), CHANGES, "Update", "EventTime").withColumn("last_seen", F.timestamp_micros("seen_us")).drop("seen_us")


def keep(spark: SparkSession, learnt_path: str, checkpoint: str, ttl_days: int, available_now: bool = False,
         interval: str = "2 seconds") -> StreamingQuery:
    """Keep the habits of the batches below ``learnt_path`` (batch folders of ``learn``) up to date.

    Runs in a session of its own, whose state store can hold maps and timers.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(LEARNT).parquet(learnt_path)
    w = changes(stream, ttl_days).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def learn(logs: DataFrame) -> DataFrame:
    """What a batch adds to the habits; its work is in proportion to the batch."""
    return learn_profile(logs.where("user is not null and timestamp is not null"))


def habits(spark: SparkSession, checkpoint: str, now: Column | None = None, ttl_days: int | None = None) -> DataFrame:
    """The habits that the state holds after its last batch; with ``now``, less those that are about to expire."""
    out = spark.read.format("statestore").option("stateVarName", "hours").load(checkpoint).select(
        "key.user", "user_map_key.hour", "user_map_value.cnt", F.timestamp_micros("user_map_value.seen_us").alias("last_seen"))
    if now is None or ttl_days is None:
        return out
    fresh = out.groupBy("user").agg(F.max("last_seen").alias("_seen")).where(F.col("_seen") > now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    return out.join(fresh, "user", "left_semi")
