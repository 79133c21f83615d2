"""Rows that rules mark by their id: right for any ids, and a small side however many rows are marked."""

import datetime as dt

from pyspark.sql import functions as F

from auditloom.config import RuleConfig, ServiceAccount
from auditloom.operators import detect as D

# "svc" may work from 8 to 17 o'clock; nights last from 22 to 5 o'clock.
CFG = RuleConfig(service_accounts={"svc": ServiceAccount(("10.0.0.1",), tuple(range(8, 18)))}, late_night_start="22:00", late_night_end="05:00")
NIGHT, DAY = dt.datetime(2024, 1, 10, 23), dt.datetime(2024, 1, 10, 12)
SCHEMA = "event_id long, user string, client_ip string, timestamp timestamp"


def tickets(spark):
    return spark.createDataFrame([("svc", dt.date(2024, 1, 10), "22:00:00", "23:30:00", None)],
                                 "user string, date date, start string, end string, ip string")


def test_marks_of_any_ids(spark):
    ids = [-(1 << 62), -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 1000, (1 << 62) + 63]
    users = ["svc", "app", "svc"]
    rows = [(k, users[n % 3], "10.0.0.1", NIGHT if n % 2 else DAY) for n, k in enumerate(ids)]
    rows += [rows[4], (None, "svc", "10.0.0.1", NIGHT), (None, "app", "10.0.0.1", DAY)]
    df = spark.createDataFrame(rows, SCHEMA)
    jumps = spark.createDataFrame([(k,) for k in ids[::4]] + [(ids[0],), (777,), (None,)], "event_id long")
    got = D._mark_rows(df, CFG, D._row_keys(df, CFG, tickets(spark), jumps))
    assert set(got.columns) == {*df.columns, "r03", "r04", "r07"}
    # A row without an id is excused by no ticket.
    want = sorted((str(k), u, str(t), k in ids[::4], u == "svc" and t == NIGHT and k is None, t == NIGHT and (u != "svc" or k is None)) for k, u, _, t in rows)
    assert sorted((str(r.event_id), r.user, str(r.timestamp), r.r03, r.r04, r.r07) for r in got.collect()) == want


def test_side_is_small_for_running_ids(spark):
    n = 64 * 500
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("svc").alias("user"), F.lit("10.0.0.1").alias("client_ip"), F.lit(NIGHT).alias("timestamp"))
    side = D._row_keys(df, CFG, tickets(spark), df.select("event_id"))
    assert side.count() == n / 64
    got = D._mark_rows(df, CFG, side)
    assert got.where("r03 and not r04 and not r07").count() == n
