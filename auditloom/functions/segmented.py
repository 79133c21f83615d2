"""Ordered operators that never need one key in one task.

A plain window over a user sends all rows of the user to a single task, which fails when one account
produces a large share of the log. Every operator here cuts a key into time slots, works inside the
slots in parallel, and passes on only one small row per (key, slot).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def time_slot(ts: Column | str, width_us: int) -> Column:
    us = micros(ts)
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us).cast("long"))


def lag_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slot: Column,
             prefix: str = "prev_", depth: int = 1) -> DataFrame:
    """Value of each column ``depth`` rows earlier for the key, exact across slots.

    ``slot`` must not decrease with ``order``. Inside a slot this is an ordinary ``lag``; the first
    ``depth`` rows of a slot look into the last rows of the earlier slots of the key.
    """
    keys = list(keys)
    row = F.struct(*[F.col(v) for v in values])
    base = df.withColumn("_slot", slot)
    w = W.partitionBy(*keys, "_slot").orderBy(*order)
    inner = base.withColumn("_lag", F.lag(row, depth).over(w)).withColumn("_pos", F.row_number().over(w))
    tails = tail_rows(base, keys, order, values, depth)
    joined = inner.join(tails, [*keys, "_slot"], "left")
    # Row p (1-based) of the slot needs the (depth - p + 1)-th newest carried row.
    carried = F.get(F.col("_carry"), F.lit(depth) - F.col("_pos"))
    picked = joined.withColumn("_lag", F.when(F.col("_pos") > depth, F.col("_lag")).otherwise(carried))
    out = picked.select(*[c for c in df.columns], *[F.col("_lag")[v].alias(f"{prefix}{v}") for v in values])
    return out


def recent_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slot: Column,
                depth: int, name: str) -> DataFrame:
    """The values of the ``depth`` rows before each row of the key, newest first, as one list of structs, exact across
    slots. One window and one join serve all depths."""
    keys = list(keys)
    row = F.struct(*[F.col(v) for v in values])
    base = df.withColumn("_slot", slot)
    w = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(-depth, -1)
    inner = base.withColumn("_near", F.collect_list(row).over(w))
    joined = inner.join(tail_rows(base, keys, order, values, depth), [*keys, "_slot"], "left")
    carried = F.coalesce("_carry", F.expr("slice(_near, 1, 0)"))
    return joined.select(*df.columns, F.slice(F.concat(F.reverse("_near"), carried), 1, depth).alias(name))


def tail_rows(base: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], depth: int) -> DataFrame:
    """For every (key, slot): the newest ``depth`` rows of all earlier slots, newest first, as ``_carry``."""
    keys = list(keys)
    row = F.struct(*[F.col(v) for v in values])
    stamp = F.struct(*[F.col(o) for o in order])
    slim = base.select(*keys, "_slot", stamp.alias("_o"), row.alias("_v"))
    if depth == 1:
        last = slim.groupBy(*keys, "_slot").agg(F.array(F.max_by("_v", "_o")).alias("_tail"))
    else:
        rank = F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(F.desc("_o")))
        # At most ``depth`` rows per group reach the list, so its size is fixed.
        last = (slim.withColumn("_r", rank).where(F.col("_r") <= depth).groupBy(*keys, "_slot")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda s: s["_v"]).alias("_tail")))
    earlier = W.partitionBy(*keys).orderBy(F.desc("_slot")).rowsBetween(1, depth)
    return (last.withColumn("_carry", F.slice(F.flatten(F.collect_list("_tail").over(earlier)), 1, depth))
            .select(*keys, "_slot", "_carry"))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], slot: Column) -> DataFrame:
    """Carry the last non-null value of each expression forward along the key, exact across slots."""
    keys = list(keys)
    base = df.withColumn("_slot", slot)
    for name, expr in values.items():
        base = base.withColumn(f"_v_{name}", expr)
    w = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = base
    for name in values:
        inner = inner.withColumn(f"_in_{name}", F.last(f"_v_{name}", ignorenulls=True).over(w))
    stamp = F.struct(*[F.col(o) for o in order])
    ends = base.groupBy(*keys, "_slot").agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), stamp)).alias(f"_end_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, "_slot", *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    joined = inner.join(carry, [*keys, "_slot"], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_in_{n}", f"_c_{n}").alias(n) for n in values])


def range_totals(df: DataFrame, keys: Sequence[str], ts: str, totals: dict[str, Column], before_us: int,
                 after_us: int = 0, where: Column | None = None) -> DataFrame:
    """Sums of each expression over the rows of the key within [ts - before_us, ts + after_us].

    A sliding frame costs rows x frame length. Here each contributing row becomes +v when it enters
    and -v when it leaves, so a running sum per (key, slot) gives the same totals in linear time. A
    slot is as long as the frame, so a row's contribution spans at most two slots. ``totals`` must
    be whole numbers, which makes the differences exact.
    """
    keys = list(keys)
    width = before_us + after_us + 1
    names = list(totals)
    own = F.expr(f"unix_micros(CAST(`{ts}` AS TIMESTAMP))")
    src = df.where(where) if where is not None else df
    c = src.select(*keys, own.alias("_s"), *[totals[n].cast("long").alias(f"_d_{n}") for n in names])
    c = c.withColumn("_in", F.col("_s") - F.lit(after_us)).withColumn("_out", F.col("_s") + F.lit(before_us + 1))
    c = c.withColumn("_a", _floor_div("_in", width)).withColumn("_b", _floor_div("_out", width))
    steps = F.array(
        F.struct(F.col("_a").alias("slot"), F.col("_in").alias("t"), F.lit(1).cast("long").alias("sign")),
        F.when(F.col("_b") > F.col("_a"), F.struct(
            F.col("_b").alias("slot"), (F.col("_b") * F.lit(width)).alias("t"), F.lit(1).cast("long").alias("sign"))),
        F.struct(F.col("_b").alias("slot"), F.col("_out").alias("t"), F.lit(-1).cast("long").alias("sign")))
    deltas = (c.withColumn("_e", F.explode(F.filter(steps, lambda x: x.isNotNull())))
              .groupBy(*keys, F.col("_e.slot").alias("_slot"), F.col("_e.t").alias("_t"))
              .agg(*[F.sum(F.col(f"_d_{n}") * F.col("_e.sign")).alias(f"_d_{n}") for n in names]))
    probes = (df.withColumn("_row", F.struct(*df.columns)).select(
        *keys, "_row", own.alias("_t"), *[F.lit(0).cast("long").alias(f"_d_{n}") for n in names])
        .withColumn("_slot", _floor_div("_t", width)))
    both = probes.unionByName(deltas, allowMissingColumns=True)
    w = W.partitionBy(*keys, "_slot").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = both.select("_row", *[F.sum(f"_d_{n}").over(w).alias(n) for n in names])
    return summed.where(F.col("_row").isNotNull()).select("_row.*", *names)


def _floor_div(name: str, width: int) -> Column:
    """Floor division of a whole number that may be negative."""
    return F.expr(f"({name} - pmod({name}, {width}L)) div {width}L")


def tumbling(ts: str, width: str) -> Column:
    """Start of the tumbling window of a time, null without one; the window function would drop such rows."""
    us, step = F.unix_micros(ts), F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    return F.timestamp_micros(us - F.pmod(us, step))
