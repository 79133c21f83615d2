"""Exact interpolated percentiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.cut import written


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      bins: int = 200, part_rows: int = 1_000_000) -> DataFrame:
    """One row per key with each named percentile (linear interpolation), nulls ignored.

    The built-in ``percentile`` buffers every distinct value of a group. Here a bounded sketch only chooses cut points
    that split the values into about ``bins`` equal parts; counts per part tell which parts hold the wanted ranks, and
    only those are kept. Parts are split again until each has at most ``part_rows`` distinct values; then they are
    ordered, each in its own task.
    """
    keys = list(keys)
    one = not keys
    src = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_x"))
    keys = keys or ["_all"]
    # One slim row per distinct value, written once: everything below reads it several times.
    values = written(src.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))).withColumn("_seg", F.lit(""))
    seg = [*keys, "_seg"]
    at = F.col("_p") * (F.col("_n") - 1)
    wanted = values.groupBy(*seg).agg(F.sum("_c").alias("_n")).select(
        *seg, "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("_p"), F.lit(side).alias("side"))
                                        for n, p in probs.items() for side in ("lo", "hi")])).alias("_r")).select(*seg, "_n", "_r.*").select(
        *seg, "name", "side", (at - F.floor(at)).alias("frac"), F.when(F.col("side") == "lo", F.floor(at)).otherwise(F.ceil(at)).cast("long").alias("rank"))
    largest = _largest(values, seg)
    grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    while largest > part_rows:
        cuts = values.groupBy(*seg).agg(F.percentile_approx("_x", grid, 10 * bins).alias("_cuts"))
        binned = values.join(cuts, seg).select(*seg, "_x", "_c", F.size(F.filter("_cuts", lambda e: e < F.col("_x"))).alias("_bin"))
        inner = W.partitionBy(*seg).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        parts = binned.groupBy(*seg, "_bin").agg(F.sum("_c").alias("_bc")).withColumn("_end", F.sum("_bc").over(inner))
        start = F.col("_end") - F.col("_bc")
        name = F.concat_ws(".", "_seg", F.col("_bin").cast("string"))
        wanted = written(wanted.join(parts, seg).where((F.col("rank") >= start) & (F.col("rank") < F.col("_end"))).select(
            *keys, name.alias("_seg"), "name", "side", "frac", (F.col("rank") - start).alias("rank")))
        values = written(binned.select(*keys, name.alias("_seg"), "_x", "_c").join(wanted.select(*seg).distinct(), seg, "left_semi"))
        before, largest = largest, _largest(values, seg)
        if largest >= before:
            break
    w = W.partitionBy(*seg).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = wanted.join(values.withColumn("_upto", F.sum("_c").over(w)), seg).where(
        (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))

    def of(n: str, side: str, what: str) -> Column:
        return F.max(F.when((F.col("name") == n) & (F.col("side") == side), F.col(what)))

    out = picked.groupBy(*keys).agg(*[(of(n, "lo", "_x") + of(n, "lo", "frac") * (of(n, "hi", "_x") - of(n, "lo", "_x"))).alias(n) for n in probs])
    return out.drop("_all") if one else out


def _largest(values: DataFrame, seg: Sequence[str]) -> int:
    """Distinct values of the largest segment."""
    return values.groupBy(*seg).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
