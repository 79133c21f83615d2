"""Sessions and spacing along a key, computed without sending a key to one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.cut import written
from auditloom.functions.segmented import HOUR_US, lag_rows, last_known, micros, time_slot


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int, order: Sequence[str], slot_us: int = HOUR_US) -> DataFrame:
    """Add ``session_start``: a new session begins after a pause longer than the gap."""
    slot = time_slot(ts, slot_us)
    seen = lag_rows(df, keys, list(order), [ts], slot, prefix="_before_")
    first = F.col(f"_before_{ts}").isNull() | (micros(ts) - micros(f"_before_{ts}") > gap_us)
    out = last_known(seen, keys, list(order), {"session_start": F.when(first, F.col(ts))}, slot)
    return out.drop(f"_before_{ts}")


def keep_spaced(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int, slot_us: int = HOUR_US, tie: str | None = None) -> DataFrame:
    """Rows that are the key's first, or at least ``gap_us`` after the last *kept* time.

    Of several rows at a kept time the one with the smallest ``tie`` stays; without it all stay.

    Keeping is a chain: whether a time is kept depends on the one kept before. A time after a pause
    of a full gap is always kept, so it can start from there. Inside a dense burst every time points
    to the first one a gap later, and doubling those pointers marks the whole chain in a number of
    steps that is the logarithm of its length; the steps are joins over written tables.
    """
    keys = list(keys)
    rows = df.withColumn("_t", micros(ts))
    nodes = rows.select(*keys, "_t").distinct()
    slot = F.call_function("div", F.col("_t") - F.pmod("_t", F.lit(slot_us)), F.lit(slot_us).cast("long"))
    seen = written(lag_rows(nodes, keys, ["_t"], ["_t"], slot))
    lone = F.col("prev__t").isNull() | (F.col("_t") - F.col("prev__t") >= gap_us)
    heads = seen.where(lone).select(*keys, "_t")
    bursts = last_known(seen, keys, ["_t"], {"_h": F.when(lone, F.col("_t"))}, slot)
    longest = bursts.agg(F.max(F.col("_t") - F.col("_h")).alias("m")).first().m or 0
    kept = heads
    if longest >= gap_us:
        inside = bursts.select(*keys, "_t", "_h")
        jump = written(_next_at_or_after(inside, [*keys, "_h"], gap_us, slot_us).select(*keys, "_t", "_n"))
        rounds = math.ceil(math.log2(longest / gap_us + 1))
        for i in range(rounds):
            hop = kept.join(jump, [*keys, "_t"]).select(*keys, F.col("_n").alias("_t"))
            kept = written(kept.unionByName(hop).distinct())
            if i == rounds - 1:
                break
            two = jump.select(*keys, F.col("_t").alias("_n"), F.col("_n").alias("_n2"))
            jump = written(jump.join(two, [*keys, "_n"]).select(*keys, "_t", F.col("_n2").alias("_n")))
    out = rows.join(kept, [*keys, "_t"], "left_semi")
    if tie is None:
        return out.select(*df.columns)
    first = out.groupBy(*keys, "_t").agg(F.min_by(F.struct(*df.columns), F.col(tie)).alias("_row"))
    return first.select("_row.*")


def _next_at_or_after(nodes: DataFrame, keys: Sequence[str], gap_us: int, slot_us: int) -> DataFrame:
    """For each node time: the smallest node time of the key that is at least a gap later."""
    keys = list(keys)
    # Walk backwards in time: the last node seen before reaching t + gap is the first one at or after it.
    back = nodes.select(*keys, (-F.col("_t")).alias("_r"), F.lit(0).alias("_q"), F.col("_t").alias("_node"), F.lit(None).cast("long").alias("_from"))
    ask = nodes.select(*keys, (-(F.col("_t") + F.lit(gap_us))).alias("_r"), F.lit(1).alias("_q"), F.lit(None).cast("long").alias("_node"), F.col("_t").alias("_from"))
    both = back.unionByName(ask)
    slot = F.call_function("div", F.col("_r") - F.pmod("_r", F.lit(slot_us)), F.lit(slot_us).cast("long"))
    found = last_known(both, keys, ["_r", "_q"], {"_n": F.col("_node")}, slot)
    return found.where(F.col("_from").isNotNull() & F.col("_n").isNotNull()).select(*keys, F.col("_from").alias("_t"), "_n")
