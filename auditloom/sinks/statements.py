"""Statements stored once: inserts that ignore what is there already, behind a filter of fingerprints per day.

A statement's key is (fingerprint, event_ts), so only rows of its own day can be its double. Beside the daily rows the store
keeps, per day, the bits of a Bloom filter in bitmaps of ``BITMAP_BITS`` bits, one row each, made by Spark's bitmap
functions while a batch is stored. An insert first looks its rows' bits up: a row with a missing bit is new without a look at the
stored rows. Only the rest, true doubles and a few percent of false hits, meets the stored fingerprints, and of these only the days
in question are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.cut import written
from auditloom.functions.joins import measured
from auditloom.sinks.tables import write_daily

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
KEY = ("fingerprint", "event_ts")
ROWS, FILTER = "rows", "filter"


@dataclass
class StatementStore:
    """Rows below ``path/rows`` by day, bits below ``path/filter`` by day.

    ``bitmaps`` x 32,768 positions a day are used: about 16 for every statement of a busy day keep false hits near 1.5 %.
    The default, 512 (at most 2 MiB a day), suits a million statements a day; fewer positions cost time, never
    rows. The number belongs to the store and must stay. Filter rows of many small batches are merged by ``compact``.

    Bits are stored before rows: after a failure between the two there are bits without rows, which are false hits. A
    repeated batch finds its rows and inserts nothing. One writer at a time.

    Defined results: of equal keys in a batch one row stays; a row whose key has a null is never a double of another and is
    always stored; rows without a time lie in the day folder of nulls.
    """

    path: str
    bitmaps: int = 512

    def positions(self) -> Column:
        """The two bits of a fingerprint."""
        bits = F.lit(self.bitmaps * BITMAP_BITS)
        return F.array(F.pmod(F.xxhash64(F.lit(1), "fingerprint", "event_ts"), bits), F.pmod(F.xxhash64(F.lit(2), "fingerprint", "event_ts"), bits))

    def rows(self, spark: SparkSession) -> DataFrame | None:
        return self._read(spark, ROWS)

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        days = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/event_date=*")
        any_day = days.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(days)
        return spark.read.parquet(f"{self.path}/{name}") if any_day else None

    def bits(self, df: DataFrame) -> DataFrame:
        """event_date, bitmap_no, bitmap of the rows' fingerprints."""
        at = df.select("event_date", F.explode(self.positions()).alias("at"))
        return at.groupBy("event_date", F.floor(F.col("at") / BITMAP_BITS).cast("int").alias("bitmap_no")).agg(
            F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bitmap"))

    def possible(self, keys: DataFrame, days: list) -> DataFrame | None:
        """Keys of which every bit is set; None if nothing is stored for their days."""
        stored = self._read(keys.sparkSession, FILTER)
        if stored is None or not days:
            return None
        near = stored.where(F.col("event_date").isin(days))
        asked = keys.withColumn("at", F.explode(self.positions())).select(
            *KEY, "event_date", F.floor(F.col("at") / BITMAP_BITS).cast("int").alias("bitmap_no"), (F.col("at") % BITMAP_BITS).cast("int").alias("bit"))
        # One byte of the bitmap as a number; bits count from the lowest of the first byte.
        octet = F.expr("CAST(conv(hex(substring(bitmap, bit DIV 8 + 1, 1)), 16, 10) AS INT)")
        found = near.join(measured(asked), ["event_date", "bitmap_no"]).where(octet.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0)
        # Several batches may have set the same bit.
        return found.groupBy("event_date", *KEY).agg(F.countDistinct("bitmap_no", "bit").alias("n"), F.first(F.size(F.array_distinct(
            self.positions()))).alias("want")).where("n = want").select("event_date", *KEY)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch, each key once, that the store does not hold."""
        whole = F.col("fingerprint").isNotNull() & F.col("event_ts").isNotNull()
        rows = batch.withColumn("event_date", F.to_date("event_ts"))
        once = written(rows.where(whole).dropDuplicates(list(KEY)).unionByName(rows.where(~whole)))
        keys = once.where(whole).select(*KEY, "event_date")
        days = [r.event_date for r in keys.select("event_date").distinct().collect()]  # one value a day
        maybe, held = self.possible(keys, days), self.rows(batch.sparkSession)
        if maybe is None or held is None:
            return once
        asked = measured(maybe)
        # Stored fingerprints of these days pass by the few keys in question; texts are not read.
        there = measured(held.where(F.col("event_date").isin(days)).select(*KEY, "event_date").join(asked, [*KEY, "event_date"], "left_semi").distinct())
        return once.join(there, [*KEY, "event_date"], "left_anti")

    def insert(self, batch: DataFrame) -> DataFrame:
        """Store what is new; returns it."""
        new = written(self.fresh(batch))
        self.bits(new.where(F.col("fingerprint").isNotNull() & F.col("event_ts").isNotNull())).write.mode("append").partitionBy("event_date").parquet(f"{self.path}/{FILTER}")
        write_daily(new, f"{self.path}/{ROWS}", sort=("event_ts",))
        return new

    def compact(self, spark: SparkSession, days: list[str]) -> None:
        """One row per bitmap for days that many batches wrote to. Their old files go only when the merged ones are written."""
        stored = self._read(spark, FILTER)
        if stored is None or not days:
            return
        merged = written(stored.where(F.col("event_date").isin(days)).groupBy("event_date", "bitmap_no").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{self.path}/{FILTER}")
