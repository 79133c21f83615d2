"""Insert-ignore behind the filter of fingerprints equals the anti join with everything stored."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.sinks.statements import FILTER, StatementStore


def made(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, t string, body string").select(
        "fingerprint", F.col("t").try_cast("timestamp").alias("event_ts"), "body")


@pytest.mark.parametrize("bitmaps", [1, 64])
def test_each_key_once(spark, tmp_path, bitmaps):
    rnd = random.Random(bitmaps)
    store, seen = StatementStore(str(tmp_path / "s"), bitmaps), set()
    for k in range(4):
        rows = [(f"f{rnd.randrange(3000)}", f"2024-01-{rnd.randrange(1, 4):02d} 10:00:{rnd.randrange(2):02d}", "x") for _ in range(1500)]
        got = [(r.fingerprint, str(r.event_ts)) for r in store.insert(made(spark, rows)).collect()]
        want = {(f, t) for f, t, _ in rows} - seen
        assert len(got) == len(set(got)) and set(got) == want
        seen |= want
        if k == 2:
            before = store._read(spark, FILTER).count()
            store.compact(spark, ["2024-01-01", "2024-01-02", "2024-01-03"])
            after = spark.read.parquet(f"{store.path}/{FILTER}")
            assert after.count() == after.select("event_date", "bitmap_no").distinct().count() <= before
    assert {(r.fingerprint, str(r.event_ts)) for r in store.rows(spark).collect()} == seen
    assert store.rows(spark).count() == len(seen)


def test_repeated_batch_nulls_and_empty(spark, tmp_path):
    store = StatementStore(str(tmp_path / "s"))
    empty = made(spark, [("a", "2024-01-01 00:00:00", "x")]).limit(0)
    assert store.insert(empty).count() == 0
    rows = made(spark, [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-02 00:00:00", "x"), (None, "2024-01-01 00:00:00", "y"),
                        (None, "2024-01-01 00:00:00", "y"), ("b", "no time", "z")])
    assert store.insert(rows).count() == 5
    again = store.insert(rows).collect()
    assert sorted(r.body for r in again) == ["y", "y", "z"]


def test_new_rows_do_not_meet_the_store(spark, tmp_path):
    """Few false hits, and the stored rows are read for the days in question only, keys without texts."""
    store = StatementStore(str(tmp_path / "s"))
    day = [(f"f{i}", f"2024-01-0{i % 3 + 1} 00:00:00", "text") for i in range(6000)]
    store.insert(made(spark, day))
    fresh = made(spark, [(f"g{i}", "2024-01-02 00:00:00", "text") for i in range(3000)]).withColumn("event_date", F.to_date("event_ts"))
    days = [r.event_date for r in fresh.select("event_date").distinct().collect()]
    assert store.possible(fresh.select("fingerprint", "event_ts", "event_date"), days).count() <= 3
    mine = made(spark, day).withColumn("event_date", F.to_date("event_ts")).where("event_date = DATE'2024-01-02'")
    assert store.possible(mine.select("fingerprint", "event_ts", "event_date"), days).count() == 2000
    plan = store.possible(mine.select("fingerprint", "event_ts", "event_date"), days)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
