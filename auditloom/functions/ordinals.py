"""Dense codes of values in their order, for any number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.cut import written


def ordinals(df: DataFrame, column: str) -> DataFrame:
    """``value`` and ``code`` (0, 1, ... in the order of the values) of every distinct value that is not null.

    Values are dealt by ranges and written; a range's values are counted, and the counts of the ranges before it are where its
    codes begin. Only these counts, one per range, meet in one task.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    dealt = written(values.repartitionByRange(parts, "value").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return dealt.join(F.broadcast(starts), "_part").select("value", (F.col("_start") + inside - 1).alias("code"))


def coded(df: DataFrame, known: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``<column>_code``: the ordinal among the values of ``known``; all others share the next code."""
    from auditloom.functions.joins import measured
    codes = measured(ordinals(known, column) if codes is None else codes)
    n = codes.agg(F.count("*")).scalar()
    return df.withColumn("_n", n).join(codes, df[column] == codes["value"], "left").withColumn(
        f"{column}_code", F.coalesce("code", "_n").cast("double")).drop("value", "code", "_n")
