"""Work that is done once however many readers it has, and in tasks of bounded size."""

import datetime as dt
import hashlib
import json
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from auditloom.functions import batched, text
from auditloom.functions.joins import spread
from auditloom.llm import bpe
from auditloom.operators import features as FE
from auditloom.operators import ml as M
from auditloom.operators import rules as R
from auditloom.plans import inputs as I
from auditloom.plans import q_stream
from auditloom.plans.registry import catalog
from auditloom.sources import general_log as GL

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    kinds = ("click", "view", "purchase", "signup", "error")
    events = [(i, START + dt.timedelta(minutes=97 * i), i % 11, kinds[i % 5], float(i % 50), f'{{"k": {i % 100}}}') for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i * 7) for i in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,), (1,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def explained(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_the_log_is_detected_once_for_training_and_reading(spark, tables, monkeypatch):
    runs, trained_on, detection = [], [], I.detection
    monkeypatch.setattr(I, "detection", lambda *a: runs.append(a) or detection(*a))
    monkeypatch.setattr(M, "train", lambda rows: trained_on.extend(r.event_id for r in rows.select("event_id").collect()))
    got = I.stored(spark, tables)
    assert len(runs) == 1
    want = detection(spark, tables)
    assert sorted(trained_on) == sorted(r.event_id for r in want.clean.select("event_id").collect())
    cols = [c for c in got.logs.columns if c != "event_date"]
    assert sorted(map(str, got.logs.select(cols).collect())) == sorted(map(str, want.logs.select(cols).collect()))


def test_stored_log_is_written_without_a_shuffle_by_day(spark, tables, monkeypatch):
    monkeypatch.setattr(M, "train", lambda rows: None)
    logs = I.stored(spark, tables).logs
    assert not [f for f in logs.inputFiles() if "event_date=" in f] and logs.where("event_date = '2024-01-02'").count() > 0


def test_entropy_replaces_each_character_once(spark, capsys):
    texts = ["", "aab", "é€𝄞é", "x'; DROP", None]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    out = df.select("q", text.entropy(F.col("q")).alias("e"))
    assert explained(out, capsys).count("replace(") == 1
    for r in out.collect():
        shares = [r.q.count(c) / len(r.q) for c in dict.fromkeys(r.q or "")]
        assert r.e == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-12)


def test_statistics_of_users_need_no_rolling_frame(spark, tables, monkeypatch, capsys):
    plans, measured = [], FE.measured
    monkeypatch.setattr(FE, "measured", lambda df: plans.append(explained(df, capsys)) or measured(df))
    rows = FE.enrich(I.audit(spark, tables))
    assert len(plans) == 1 and "Window" not in plans[0] and "regexp" not in plans[0]
    again = FE.z_scores(FE.rolling_5m(FE.static_features(I.audit(spark, tables))))
    z = ["execution_time_ms_zscore", "rows_returned_zscore", "data_retrieval_speed_zscore"]
    got, want = ({r.event_id: [r[c] for c in z] for r in d.select("event_id", *z).collect()} for d in (rows, again))
    assert len(got) == 200 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_features_are_made_once_for_training_and_scores(spark, tables, monkeypatch):
    made, enrich = [], FE.enrich
    monkeypatch.setattr(FE, "enrich", lambda df: made.append(1) or enrich(df))
    monkeypatch.setattr(M, "train", lambda rows: rows.count())
    monkeypatch.setattr(M, "save_model", lambda model, *a: str(model))
    monkeypatch.setattr(M, "load_model", lambda path, version: version)
    monkeypatch.setattr(M, "score", lambda model, rows: rows.withColumn("ml_anomaly_score", F.lit(0.5)))
    out = catalog().items["m08_saved_model"].run(spark, tables)
    assert out.first().asDict() == {"n": 200, "different": 0} and len(made) == 1


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spread(spark.read.parquet(f"{tmp_path}/t"), least=2, task_rows=100)
    assert df.rdd.getNumPartitions() == 10
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) <= 150


def test_entropy_of_batches_is_that_of_single_texts(spark, capsys):
    texts = ["", None, "aab", "é€𝄞é", "x'; DROP", "a" * 5000, *[chr(97 + i % 26) * (i % 7) + str(i) for i in range(3000)], "é" + "ab" * 600_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, q string").coalesce(1)
    got = df.select("i", text.entropy(F.col("q")).alias("a"), batched.entropy(F.col("q")).alias("b")).collect()
    assert len(got) == len(texts) and all(r.b == pytest.approx(r.a, abs=1e-9) for r in got)
    given = spark.createDataFrame([(1.5, "aab"), (None, "ab")], "query_entropy double, query string")
    assert sorted(r.query_entropy for r in R.with_entropy(given).collect()) == [1.0, 1.5]
    assert "ArrowEvalPython" in explained(R.with_entropy(given), capsys)


def test_ticket_times_are_read_once_per_ticket(spark, capsys):
    """Clock texts are split below the join, so pairs of rows and tickets only compare numbers."""
    at = lambda h, m=0: dt.datetime(2024, 1, 3, h, m)
    rows = spark.createDataFrame([(i, "u", ip, t) for i, (ip, t) in enumerate([("a", at(23)), ("b", at(23)), ("a", at(0, 10)), ("a", at(1)), ("a", at(2)), ("a", None)])],
                                 "event_id long, user string, client_ip string, timestamp timestamp")
    day = dt.date(2024, 1, 3)
    tickets = spark.createDataFrame([("u", day, "22:00:00", "00:30", " a "), ("u", day, "01:00", "01:30:00", None), ("u", day, "01:00", "01:30:00", None),
                                     ("u", day, None, None, ""), (None, day, "00:00", "23:59", "")], "user string, date date, start string, end string, ip string")
    got = R.with_ticket(rows, tickets, True)
    assert sorted(r.event_id for r in got.collect()) == [0, 2, 3] and got.columns == rows.columns
    assert sorted(r.event_id for r in R.without_ticket(rows, tickets, True).collect()) == [1, 4, 5]
    assert sorted(r.event_id for r in R.with_ticket(rows, tickets.drop("ip"), False).collect()) == [0, 1, 2, 3]
    joins = [line for line in explained(got, capsys).splitlines() if "Join" in line]
    assert joins and not any("split(" in line for line in joins)


def test_log_lines_are_classified_once(spark, capsys):
    t = "2024-01-01T00:00:0{}.000000Z 7 "
    values = [t.format(0) + "Connect u@h on d using TCP", t.format(1) + "Query SELECT 1", "  more ", "", t.format(2) + "Query USE x", t.format(3) + "Quit"]
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(values)], "file string, block long, pos long, value string")
    out = GL.parse_general_log(lines)
    assert "Connect" not in explained(out, capsys)
    assert [(r.query, r.database, r.user) for r in out.orderBy("pos").collect()] == [("SELECT 1\n  more", "d", "u"), ("USE x", "x", "u")]


def test_a_feed_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x
    df = spark.range(10).select(counted("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    read = []
    q_stream.feed(spark, df, "ts", "once", lambda stream: read.append(stream) or SimpleNamespace(awaitTermination=lambda: None))
    assert made.value == 10 and len(read) == q_stream.FEEDS


def test_tokens_are_made_and_read_back_by_one_worker(spark, tmp_path, capsys):
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b"]}, "added_tokens": [{"content": "<s>", "id": 257}]}))
    df = spark.createDataFrame([(1, "abba <s>é", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, extra long")
    out = bpe.round_trip(df, str(path))
    assert explained(out, capsys).count("MapInArrow") == 1
    two = bpe.decode(bpe.encode(df, str(path)), str(path))
    want = {r.doc_id: (bytes(r.token_ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in two.collect()}
    assert {r.doc_id: (bytes(r.token_ids), r.decoded_sha256) for r in out.collect()} == want and two.columns == [*df.columns, "token_ids", "decoded"]
