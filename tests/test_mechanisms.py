"""Ordinal codes, late windows and observed writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions.ordinals import coded, ordinals
from auditloom.sinks import tables as K
from auditloom.streaming.batches import written
from auditloom.streaming.windows import WindowCounts

START = dt.datetime(2024, 1, 1)


def test_ordinals(spark):
    r = random.Random(1)
    values = ["".join(r.choice("abcdé") for _ in range(r.randrange(0, 5))) for _ in range(3000)] + ["hot"] * 2000 + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}, key=lambda x: x.encode()))}
    assert {x.value: x.code for x in ordinals(df, "v").collect()} == want
    known = df.where("v < 'c'")
    small = sorted((v for v in want if v.encode() < b"c"), key=lambda x: x.encode())
    got = {x.v: x.v_code for x in coded(df, known, "v").distinct().collect()}
    assert got == {v: float(small.index(v)) if v in small else float(len(small)) for v in set(values)}
    assert ordinals(df.limit(0), "v").count() == 0 and {x.v_code for x in coded(df, df.limit(0), "v").collect()} == {0.0}


def test_late_rows_correct_their_windows(spark, tmp_path):
    job = WindowCounts(str(tmp_path / "out"), minutes=5, delay="10 seconds")
    feeds = [[("u", 0), ("u", 100), ("v", 299)], [("u", 900), ("u", 895)], [("u", 50), ("u", 891), ("w", None), ("v", 900)], []]
    for k, rows in enumerate(feeds):
        job(spark.createDataFrame([(u, None if s is None else START + dt.timedelta(seconds=s)) for u, s in rows], "user string, timestamp timestamp"), k)
    got = {(r.user, (r.window_start - START).seconds): (r.n, r.late) for r in job.windows(spark).collect()}
    assert got == {("u", 0): (3, 1), ("v", 0): (1, 0), ("u", 900): (1, 0), ("u", 600): (2, 0), ("v", 900): (1, 0)}
    fixes = [(r.user, (r.window_start - START).seconds, r.n, r.batch_id) for r in written(spark, f"{job.out}/corrections").collect()]
    assert fixes == [("u", 0, 3, 2)]
    assert sorted((r.user, r.timestamp) for r in written(spark, f"{job.out}/late").where("timestamp is not null").collect()) == [("u", START + dt.timedelta(seconds=50))]
    assert written(spark, f"{job.out}/late").where("timestamp is null").count() == 1


def test_observed_writes(spark, tmp_path):
    df = spark.range(1000)
    good = K.metered(df, lambda d: d.write.parquet(str(tmp_path / "a")), "a")
    assert good["rows_inserted"] == 1000 and good["error"] is None and good["duration_ms"] > 0
    bad = K.metered(df.select(F.raise_error(F.lit("no")).alias("x")), lambda d: d.write.parquet(str(tmp_path / "b")), "b")
    assert bad["rows_inserted"] == 0 and bad["error"]
    again = K.metered(df, lambda d: d.write.parquet(str(tmp_path / "a")), "a")  # the folder is there
    assert again["error"] == "AnalysisException"


def test_listener(spark, tmp_path):
    listener = K.IngestListener()
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
        broken = stream.select(F.raise_error(F.lit("no")).alias("x")).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            broken.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [b["rows_inserted"] for b in listener.batches] == [7] and all(b["duration_ms"] >= 0 for b in listener.batches) and len(listener.failed) == 1
