"""Micro-batch detection: reports at once, corrects later, and cannot be spoilt by a wrong clock."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.operators import detect as D
from auditloom.operators import rules as R
from auditloom.schema import conform
from auditloom.streaming import habits as H
from auditloom.streaming.batches import batch_ids, written
from auditloom.streaming.detection import STATE, DetectionJob

FIELDS = "event_id long, timestamp timestamp, user string, client_ip string, query string, error_code long, event_name string"
START = dt.datetime(2024, 1, 1, 9, 0)
FLAGS = [f"r{k:02d}" for k in range(1, 31)]


def frame(spark, rows):
    full = [(i, START + dt.timedelta(seconds=s) if isinstance(s, (int, float)) else s, u, ip, *(list(rest) + ["SELECT 1 FROM b", 0, "query"][len(rest):]))
            for i, s, u, ip, *rest in rows]
    return spark.createDataFrame(full, FIELDS)


def flags_of(logs, keys=FLAGS):
    return {r.event_id: tuple(k for k in keys if r[k]) for r in logs.select("event_id", *keys).collect()}


@pytest.fixture
def places(spark):
    return spark.createDataFrame([(167772160 + k * 256, 167772160 + k * 256 + 255, 50.0 * k, 10.0) for k in range(2)],
                                 "start_num long, end_num long, lat double, lon double")


def test_stream_equals_batch(spark, tmp_path, places):
    """Batches that cut windows, pauses between a user's places and sessions, with late rows, end at what one batch run finds."""
    texts = ("SELECT * FROM hr_db.a -- x", "SELECT 1 FROM b", "SELECT 1 FROM c JOIN d ON 1 = 1", "SELECT 1 FROM e.f JOIN g ON 1 = 1")
    rows = [(i, dt.datetime(2024, 1, 1, 3) + dt.timedelta(seconds=37 * i), f"u{i // 9 % 3}", f"10.0.{i % 2}.{i % 4}", texts[i % 4],
             1045 if i % 5 < 3 else 0, "connect") for i in range(120)]
    df = frame(spark, rows)
    cfg = RuleConfig(brute_force_attempts=4, brute_force_window="60 minutes")
    job = DetectionJob(str(tmp_path / "out"), lambda: cfg, geo_ranges=places)
    cuts = ("event_id < 31 AND event_id <> 14", "event_id = 31", "event_id IN (14, 97) OR event_id BETWEEN 32 AND 89", "event_id > 89 AND event_id <> 97")
    for k, cut in enumerate(cuts):
        job(df.where(cut), k)
    job(df.where(cuts[3]), 3)  # a batch that is delivered again changes nothing
    batch, found = D.detect(conform(df), cfg, geo_ranges=places), job.result(spark)
    got, want = flags_of(found.logs), flags_of(batch.logs)
    assert got == want and len(got) == 120
    assert {"r01", "r02", "r03", "r30"} <= {k for v in want.values() for k in v}

    def session(r):
        return r.user, r.start_time, r.end_time, tuple(r.details.tables), r.details.query_count
    sessions = {session(r) for r in D.session_anomalies(batch.sessions).collect()}
    assert {session(r) for r in D.session_anomalies(found.sessions).collect()} == sessions and sessions
    # What the sinks got, the last report of each session and row counting, says the same.
    reported = written(spark, f"{job.out}/sessions")
    last = reported.groupBy("user", "session_start").agg(F.max_by(F.struct(*reported.columns), "batch_id").alias("r")).select("r.*")
    assert {session(r) for r in last.collect()} == sessions
    kinds = written(spark, f"{job.out}/anomalies").groupBy("event_id", "behavior_group").agg(F.max("batch_id").alias("b"))
    newest = kinds.join(kinds.groupBy("event_id").agg(F.max("b").alias("b")), ["event_id", "b"])
    assert {(r.event_id, r.behavior_group) for r in newest.collect()} == {(r.event_id, r.behavior_group) for r in batch.anomalies.collect()}
    # State of batches that none reads again is gone.
    assert all(set(batch_ids(spark, f"{job.out}/{s}")) <= {2, 3} for s in STATE)


def test_row_rules_in_their_own_batch(spark, tmp_path):
    job = DetectionJob(str(tmp_path / "out"), RuleConfig)
    job(frame(spark, [(1, 0, "u", "10.0.0.1", "SELECT * FROM t WHERE a = 1 UNION SELECT b FROM c")]), 0)
    assert "r11" in flags_of(written(spark, f"{job.out}/logs"))[1]
    assert written(spark, f"{job.out}/anomalies").where("event_id = 1").count() and written(spark, f"{job.out}/alerts").count()


@pytest.mark.parametrize("bad", [None, dt.datetime(2099, 1, 1)])
def test_wrong_clock_spoils_nothing(spark, tmp_path, bad):
    """Three addresses within 40 seconds, in three batches; one row of the first may come from 2099."""
    job = DetectionJob(str(tmp_path / "out"), RuleConfig)
    feeds = [[(1, 0, "u", "10.0.0.1"), (2, bad, "u", "10.0.0.9", "SELECT 1 UNION SELECT 2")] if bad else [(1, 0, "u", "10.0.0.1")],
             [(3, 20, "u", "10.0.0.2"), (4, 21, "v", "10.0.0.2")], [(5, 40, "u", "10.0.0.3")]]
    seen = []
    for k, rows in enumerate(feeds):
        job(frame(spark, rows), k)
        seen.append({e for e, r in flags_of(job.result(spark).logs, ["r01"]).items() if r})
    assert seen == [set(), {1, 3}, {1, 3, 5}]
    if bad:
        row = job.result(spark).logs.where("event_id = 2").first()
        assert row.quarantined and row.r11 and not row.r01


def test_attack_found_late_corrects_earlier_logins(spark, tmp_path):
    cfg = RuleConfig(brute_force_attempts=2, brute_force_window="60 minutes")
    job = DetectionJob(str(tmp_path / "out"), lambda: cfg)
    fail = ("SELECT 1", 1045, "connect")
    job(frame(spark, [(1, 0, "u", "10.0.0.1", "SELECT 1", 0, "connect"), (2, 5, "u", "10.0.0.1", *fail)]), 0)
    job(frame(spark, [(3, 7200, "w", "10.0.0.2"), (4, 10, "u", "10.0.0.1", *fail)]), 1)
    assert not any(flags_of(job.result(spark).logs, ["r02"]).values())
    job(frame(spark, [(5, 15, "u", "10.0.0.1", *fail), (6, 9000, "u", "10.0.0.1", "SELECT 1", 0, "connect")]), 2)
    assert {e for e, r in flags_of(job.result(spark).logs, ["r02"]).items() if r} == {1, 6}
    assert [(r.event_id, r.batch_id) for r in written(spark, f"{job.out}/corrections").collect()] == [(1, 2)]


def test_empty_batches(spark, tmp_path):
    job = DetectionJob(str(tmp_path / "out"), RuleConfig)
    for k in range(3):
        job(frame(spark, [(k, k, "u", "10.0.0.1")] if k == 1 else []), k)
    assert job.result(spark).logs.count() == 1


def test_habits_are_kept_and_expire(spark, tmp_path):
    """Counts add up over batches and restarts, a repeated batch counts once, and a user unseen for the TTL is forgotten."""
    out, state = str(tmp_path / "learnt"), str(tmp_path / "state")

    def add(batch_id, rows, folder=None):
        df = spark.createDataFrame([(u, h, n, START + dt.timedelta(days=d)) for u, h, n, d in rows], "user string, hour int, cnt bigint, last_seen timestamp")
        df.write.mode("append").parquet(f"{out}/batch_id={batch_id}")
        H.keep(spark, out, state, 10, available_now=True).awaitTermination()
        return {(r.user, r.hour): r.cnt for r in H.habits(spark, state).collect()}

    assert add(0, [("a", 9, 2, 0), ("a", 10, 1, 0), ("b", 9, 5, 0)]) == {("a", 9): 2, ("a", 10): 1, ("b", 9): 5}
    assert add(1, [("a", 9, 3, 1)]) == {("a", 9): 5, ("a", 10): 1, ("b", 9): 5}
    assert add(1, [("a", 9, 3, 1)]) == {("a", 9): 5, ("a", 10): 1, ("b", 9): 5}
    assert add(2, [("c", 1, 1, 10.5)]) == {("a", 9): 5, ("a", 10): 1, ("c", 1): 1}
    assert add(3, [("b", 9, 1, 11), ("a", 9, 1, 11)]) == {("a", 9): 6, ("a", 10): 1, ("b", 9): 1, ("c", 1): 1}


def test_habits_enter_detection(spark, tmp_path):
    cfg = RuleConfig(min_occurrences_threshold=2)
    state = str(tmp_path / "state")
    job = DetectionJob(str(tmp_path / "out"), lambda: cfg)
    job(frame(spark, [(k, k, "u", "10.0.0.1") for k in range(3)]), 0)
    H.keep(spark, f"{job.out}/learnt", state, 30, available_now=True).awaitTermination()
    assert {(r.user, r.hour, r.cnt) for r in H.habits(spark, state).collect()} == {("u", 9, 3)}
    job.habits = lambda: H.habits(spark, state)
    job(frame(spark, [(10, 60, "u", "10.0.0.1"), (11, 4 * 3600, "u", "10.0.0.1")]), 1)
    hit = {r.event_id for r in job.result(spark).logs.where(f"hit_{R.PROFILE}").select("event_id").collect()}
    assert 11 in hit and 10 not in hit
