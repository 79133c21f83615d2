"""Operators over ordered rows: slots, hot keys, ties and frame edges, each against plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.functions.chains import keep_spaced, sessionize
from auditloom.functions.quantiles import exact_percentiles
from auditloom.functions.segmented import lag_rows, last_known, range_totals, time_slot
from auditloom.operators import features as FE

T0 = dt.datetime(2024, 1, 1)
MIN = 60_000_000


def rows(n, hot=0.4, span_min=600, seed=1, step=0.25):
    """One key holds a large share of the rows; many times repeat."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if rnd.random() < hot else f"u{rnd.randrange(5)}"
        out.append((i, user, T0 + dt.timedelta(minutes=round(rnd.uniform(0, span_min) / step) * step), rnd.randrange(50)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "event_id long, user string, timestamp timestamp, v int").repartition(7)


def test_lag_across_slots(spark):
    data = rows(800)
    for depth in (1, 3):
        got = {r.event_id: r.prev_v for r in lag_rows(frame(spark, data), ["user"], ["timestamp", "event_id"], ["v"], time_slot("timestamp", 10 * MIN), depth=depth).collect()}
        pdf = pd.DataFrame(data, columns=["event_id", "user", "timestamp", "v"]).sort_values(["user", "timestamp", "event_id"])
        want = pdf.groupby("user")["v"].shift(depth)
        assert len(got) == len(data)
        for i, v in zip(pdf["event_id"], want):
            assert got[i] == (None if pd.isna(v) else int(v))


def test_last_known_across_slots(spark):
    data = rows(600, seed=2)
    df = frame(spark, data)
    out = last_known(df, ["user"], ["timestamp", "event_id"], {"seen": F.when(F.col("v") < 5, F.col("v"))}, time_slot("timestamp", 15 * MIN))
    got = {r.event_id: r.seen for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["event_id", "user", "timestamp", "v"]).sort_values(["user", "timestamp", "event_id"])
    want = pdf["v"].where(pdf["v"] < 5).groupby(pdf["user"]).ffill()
    for i, v in zip(pdf["event_id"], want):
        assert got[i] == (None if pd.isna(v) else int(v))


def test_rolling_totals_against_brute_force(spark):
    data = rows(500, seed=3) + [(9001, "edge", T0, 1), (9002, "edge", T0 + dt.timedelta(minutes=5), 2), (9003, "edge", T0 + dt.timedelta(minutes=5), 4)]
    df = frame(spark, data)
    got = {r.event_id: (r.n, r.s) for r in range_totals(df, ["user"], "timestamp", {"n": F.lit(1), "s": F.col("v")}, 5 * MIN - 1).collect()}
    for i, u, t, _ in data:
        inside = [v for _, u2, t2, v in data if u2 == u and t - dt.timedelta(minutes=5) < t2 <= t]
        assert got[i] == (len(inside), sum(inside))
    # A row exactly five minutes old has left the frame; rows of equal time see each other.
    assert got[9002] == got[9003] == (2, 6)
    around = {r.event_id: r.n for r in range_totals(df, ["user"], "timestamp", {"n": F.lit(1)}, 2 * MIN, 2 * MIN, F.col("v") % 2 == 0).collect()}
    for i, u, t, _ in data:
        assert around[i] == sum(1 for _, u2, t2, v in data if u2 == u and abs((t2 - t).total_seconds()) <= 120 and v % 2 == 0)


def test_rolling_features_match_pandas(spark):
    rnd = random.Random(4)
    secs = rnd.sample(range(86_400), 400)
    data = [(i, f"u{i % 3}", T0 + dt.timedelta(seconds=s), rnd.randrange(100)) for i, s in enumerate(secs)]
    df = frame(spark, data).withColumns({"query_length": F.col("v"), "has_error": (F.col("v") % 2).cast("int"), "rows_returned": F.col("v").cast("long")})
    got = FE.rolling_5m(df).toPandas().set_index("event_id")
    pdf = pd.DataFrame(data, columns=["event_id", "user", "timestamp", "v"])
    for _, g in pdf.groupby("user"):
        g = g.set_index("timestamp").sort_index()
        roll = g["v"].rolling("5min")
        want = pd.DataFrame({"event_id": g["event_id"], "n": roll.count(), "std": roll.std().fillna(0), "sum": roll.sum()})
        for r in want.itertuples():
            assert got.loc[r.event_id, "query_count_5m"] == r.n and got.loc[r.event_id, "total_rows_5m"] == r.sum
            assert abs(got.loc[r.event_id, "query_len_std_5m"] - r.std) < 1e-6


def spaced(times, gap):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return set(kept)


def test_keep_spaced_micro(spark):
    data = [(m, "k", T0 + dt.timedelta(minutes=m), 0) for m in (0, 4, 6, 9, 12)] + [(100, "x", T0, 0), (105, "x", T0 + dt.timedelta(minutes=5), 0)]
    got = sorted(r.event_id for r in keep_spaced(frame(spark, data), ["user"], "timestamp", 5 * MIN).collect())
    assert got == [0, 6, 12, 100, 105]


def test_keep_spaced_dense(spark):
    data = rows(700, span_min=300, seed=5)
    got = {r.event_id for r in keep_spaced(frame(spark, data), ["user"], "timestamp", 7 * MIN, slot_us=20 * MIN).collect()}
    keep = {u: spaced([t for _, u2, t, _ in data if u2 == u], dt.timedelta(minutes=7)) for u in {d[1] for d in data}}
    assert got == {i for i, u, t, _ in data if t in keep[u]}


def test_sessionize(spark):
    data = rows(400, seed=6)
    out = sessionize(frame(spark, data), ["user"], "timestamp", 3 * MIN, ["timestamp", "event_id"], slot_us=30 * MIN)
    got = {r.event_id: r.session_start for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["event_id", "user", "timestamp", "v"]).sort_values(["user", "timestamp", "event_id"])
    for _, g in pdf.groupby("user"):
        start = prev = None
        for r in g.itertuples():
            start = r.timestamp if prev is None or r.timestamp - prev > pd.Timedelta(minutes=3) else start
            prev = r.timestamp
            assert got[r.event_id] == start.to_pydatetime()


@pytest.mark.parametrize("part_rows", [10, 100, 1_000_000])
def test_exact_percentiles(spark, part_rows):
    rnd = random.Random(7)
    data = [("a", rnd.gauss(0, 1)) for _ in range(1500)] + [("b", float(rnd.randrange(3))) for _ in range(200)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, bins=8, part_rows=part_rows).collect()}
    pdf = pd.DataFrame(data, columns=["k", "x"]).dropna()
    for k, g in pdf.groupby("k"):
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(got[k][name] - g["x"].quantile(p)) < 1e-9
    assert set(got) == {"a", "b", "c"}


def test_sequences_hold_earlier_slots(spark):
    data = rows(300, seed=8)
    out = FE.sequences(frame(spark, data), ["v"], ("user",), 5, slot_us=20 * MIN).collect()
    pdf = pd.DataFrame(data, columns=["event_id", "user", "timestamp", "v"]).sort_values(["user", "timestamp", "event_id"])
    want = {}
    for _, g in pdf.groupby("user"):
        vs, ids = list(g["v"]), list(g["event_id"])
        want.update({ids[i]: [float(v) for v in vs[i - 4:i + 1]] for i in range(4, len(vs))})
    assert {r.event_id: [v[0] for v in r.sequence] for r in out} == want
