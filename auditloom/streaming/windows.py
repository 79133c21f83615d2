"""Window counts that late rows correct instead of being lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.joins import measured
from auditloom.functions.segmented import tumbling
from auditloom.streaming.batches import before, forget, write_batch, written


@dataclass
class WindowCounts:
    """Events per user and tumbling window. A batch writes what it adds to each window, in proportion to the batch.

    Rows behind the watermark (the newest time of the batches before, less ``delay``) are kept below ``late``, and the
    windows that they belong to are written whole below ``corrections``: an upsert by user and window. Rows without a time
    belong to no window and are kept below ``late`` too.
    """

    out: str
    minutes: int = 5
    delay: str = "10 seconds"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = before(spark, f"{self.out}/clock", batch_id)
        old = spark.createDataFrame([], "newest timestamp") if old is None else old
        start = tumbling("timestamp", f"{self.minutes} minutes")
        mark = old.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {self.delay}")
        write_batch(batch.withColumn("_mark", mark).withColumn("_late", F.col("timestamp").isNull() | F.coalesce(F.col("timestamp") < F.col("_mark"), F.lit(False)))
                    .withColumn("window_start", start).drop("_mark"), f"{self.out}/rows", batch_id)
        rows = spark.read.schema(batch.withColumns({"_late": F.lit(True), "window_start": F.lit(None).cast("timestamp")}).schema).parquet(f"{self.out}/rows/batch_id={batch_id}")
        write_batch(rows.where("_late").drop("_late"), f"{self.out}/late", batch_id)
        added = rows.where("window_start is not null").groupBy("user", "window_start").agg(F.count("*").alias("n"), F.count_if("_late").alias("late"))
        write_batch(added, f"{self.out}/added", batch_id)
        write_batch(rows.select(F.col("timestamp").alias("newest")).unionByName(old).agg(F.max("newest").alias("newest")), f"{self.out}/clock", batch_id)
        touched = measured(rows.where("_late AND window_start is not null").select("user", "window_start").distinct())
        write_batch(self.windows(spark).join(touched, ["user", "window_start"], "left_semi"), f"{self.out}/corrections", batch_id)
        forget(spark, [f"{self.out}/rows", f"{self.out}/clock"], batch_id)

    def windows(self, spark: SparkSession) -> DataFrame:
        """user, window_start, n, and late: how many of the n came behind the watermark."""
        return written(spark, f"{self.out}/added").groupBy("user", "window_start").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
