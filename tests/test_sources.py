"""Log formats from real files, and streams over them."""

import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.functions import text
from auditloom.monitor import integrity as I
from auditloom.monitor.patterns import variations
from auditloom.sinks import tables as K
from auditloom.sources import files, general_log
from auditloom.streaming import jobs as J

LOG = """2024-01-01T00:00:00.000001Z\t 7 Connect\tann@10.0.0.1 on shop using TCP/IP
2024-01-01T00:00:01.000001Z\t 7 Query\tSELECT a
  FROM b

  WHERE c = 1
2024-01-01T00:00:02.000001Z\t 7 Init DB\tcrm
2024-01-01T00:00:03.000001Z\t 7 Query\tSELECT 2
2024-01-01T00:00:04.000001Z\t 7 Query\tUSE `hr-db`
2024-01-01T00:00:05.000001Z\t 7 Query\tSELECT 3
2024-01-01T00:00:06.000001Z\t 7 Quit\t
 stray line after quit
2024-01-01T00:00:07.000001Z\t 7 Query\tSELECT after_quit
2024-01-01T00:00:08.000001Z\t 99 Query\tSELECT unknown_thread
2024-01-01T00:00:09.000001Z\t 8 Connect\tbob@h2 on using Socket
2024-01-01T00:00:10.000001Z\t 8 Query\tSELECT last
"""
STATEMENTS = [("ann", "10.0.0.1", "shop", "SELECT a\n  FROM b\n  WHERE c = 1"), ("ann", "10.0.0.1", "crm", "SELECT 2"),
              ("ann", "10.0.0.1", "hr-db", "USE `hr-db`"), ("ann", "10.0.0.1", "hr-db", "SELECT 3"), ("bob", "h2", "N/A", "SELECT last")]


def as_rows(df):
    return [(r.user, r.client_ip, r.database, r.query) for r in df.orderBy("timestamp").collect()]


def test_general_log_file(spark, tmp_path):
    p = tmp_path / "general.log"
    p.write_text(LOG)
    lines = general_log.read_log_lines(spark, str(p))
    assert as_rows(general_log.parse_general_log(lines)) == STATEMENTS
    assert as_rows(general_log.parse_general_log(lines, filter_user="ann")) == STATEMENTS[-1:]


def test_general_log_in_blocks_and_batches(spark, tmp_path):
    lines = [(f"f", i // 3, i, v) for i, v in enumerate(LOG.splitlines())]
    df = spark.createDataFrame(lines, "file string, block long, pos long, value string")
    assert as_rows(general_log.parse_general_log(df)) == STATEMENTS
    for cut in (1, 3, 6, 9, 14):
        job = J.LogSessionJob(str(tmp_path / f"cut{cut}"))
        job(df.where(f"pos < {cut}"), 0)
        job(df.where(f"pos >= {cut}"), 1)
        job(df.where(f"pos >= {cut}"), 1)  # a repeated batch changes nothing
        done = J.written(spark, f"{job.out}/statements").drop("batch_id").unionByName(job.finish(spark, 1))
        assert as_rows(done) == STATEMENTS, cut


def test_pg_csvlog_file(spark, tmp_path):
    rec = lambda t, conn, msg, n=14: ",".join(f'"{c}"' for c in ([t, "ann", "shop", "1", conn] + ["x"] * 8 + [msg])[:n])
    (tmp_path / "pg.csv").write_text("\n".join([
        rec("2024-01-01 00:00:01.5 UTC", "10.0.0.1:99", 'statement: SELECT ""a"",\n b '), rec("2024-01-01 00:00:02 UTC", "", "statement: SELECT 2"),
        rec("2024-01-01 00:00:03 UTC", "h", "duration: 1 ms"), rec("2024-01-01 00:00:04 UTC", "h", "", 13)]) + "\n")
    got = [(r.timestamp, r.client_ip, r.query) for r in files.read_pg_csvlog(spark, str(tmp_path / "pg.csv")).orderBy("timestamp").collect()]
    assert got == [(dt.datetime(2024, 1, 1, 0, 0, 1, 500000), "10.0.0.1", 'SELECT "a",\n b'), (dt.datetime(2024, 1, 1, 0, 0, 2), "N/A", "SELECT 2")]


def test_action_log_and_trail(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 00:00:01,5 - ACTION: LOCK | TARGET: a@b | REASON: x | y\nnoise\n2024-01-01 00:00:02,5 - ACTION: KILL | TARGET: c | REASON: z\n")
    got = [(r.timestamp, r.action, r.target, r.reason) for r in files.read_action_log(spark, str(tmp_path / "a.log"), 5).collect()]
    assert got == [("2024-01-01 00:00:02,5", "KILL", "c", "z"), ("2024-01-01 00:00:01,5", "LOCK", "a@b", "x | y")]
    (tmp_path / "t.jsonl").write_text('{"log_type":"h"}\n{"entry_id":"1","timestamp":"a","risk_score":0.5}\n{bad\n{"entry_id":"2","timestamp":"b"}\n')
    assert [r.entry_id for r in files.read_audit_trail(spark, str(tmp_path / "t.jsonl")).collect()] == ["2", "1"]


def test_staging_stream_archives(spark, tmp_path):
    src, arch = tmp_path / "in", tmp_path / "done"
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "q"), (2, "bad", "q")], "event_id long, timestamp string, query string")
    K.write_staging(df, str(src))
    stream = files.stream_staging(spark, str(src), str(arch), schema=df.schema)
    q = stream.writeStream.format("memory").queryName("staged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.event_id for r in spark.table("staged").collect()] == [1]


def test_retention_drops_folders(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id * 20 AS INT)) AS event_date", "'u' AS user", "current_timestamp() AS timestamp")
    K.write_daily(df, str(tmp_path / "t"))
    assert K.drop_expired(spark, str(tmp_path / "t"), "2024-03-01", 30) == 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_feedback_adds_columns(spark):
    item = spark.createDataFrame([("t", "u", "q", "x", 0)], "timestamp string, user string, query string, ip string, arrival int")
    new = spark.createDataFrame([("t", "u", "q", "n1", 1), ("t", "u", "q", "n2", 2), ("t2", "u", "q", "n3", 1)], "timestamp string, user string, query string, note string, arrival int")
    got = {r.timestamp: (r.is_anomaly_label, r.ip, r.note) for r in K.upsert_feedback(K.feedback_rows(item, F.lit(0)), K.feedback_rows(new, F.lit(1))).collect()}
    assert got == {"t": (1, "x", "n2"), "t2": (1, None, "n3")}


def test_hmac_and_files(spark, tmp_path):
    for key in ("k", "x" * 100):
        keyed = I.with_key(spark.range(1), key).select(I.hmac_sha256(F.lit("héllo")).alias("h"))
        plan = keyed._jdf.queryExecution().toString().lower()
        raw = (hashlib.sha256(key.encode()).digest() if len(key) > 64 else key.encode()).ljust(64, b"\0")
        pads = [bytes(b ^ p for b in raw) for p in (0x36, 0x5C)]
        assert not any(p.hex() in plan or p[:8].decode("latin1").lower() in plan or ", ".join(map(str, p[:4])) in plan for p in pads)
        got = keyed.first().h
        assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.conf").write_text("one")
    before = I.file_checksums(spark, str(tmp_path / "f")).collect()
    (tmp_path / "f" / "a.conf").write_text("two")
    (tmp_path / "f" / "b.conf").write_text("new")
    spark.catalog.clearCache()
    old = spark.createDataFrame([(r.path, r.checksum) for r in before] + [("gone", "0")], "path string, checksum string")
    got = sorted((r.path.rsplit("/", 1)[-1], r.change) for r in I.compare_checksums(old, I.file_checksums(spark, str(tmp_path / "f"))).collect())
    assert got == [("a.conf", "changed"), ("b.conf", "new"), ("gone", "missing")]
    assert before[0].checksum == hashlib.sha256(b"one").hexdigest()


def test_trail_verification_lines(spark):
    cols = ("entry_id", "event_type")
    good = I.signed_lines(spark.createDataFrame([(2, "e2", "x"), (3, "e3", "x"), (4, "e4", "x")], "line long, entry_id string, event_type string"), cols, "k").select("line", "value")
    lines = good.withColumn("value", F.when(F.col("line") == 3, F.replace("value", F.lit('"x"'), F.lit('"y"'))).otherwise(F.col("value")))
    extra = spark.createDataFrame([(1, '{"log_type": "h"}'), (5, '{"entry_id":"e5"}'), (6, "{oops")], "line long, value string")
    got = {r.line: r.error for r in I.verify_trail(lines.unionByName(extra), cols, "k").collect()}
    assert got == {3: "Integrity verification failed at line 3", 5: "Missing integrity hash at line 5", 6: "Corrupted entry at line 6"}


def test_unicode_words_are_normalised(spark):
    q = """SELECT 'Nguyễn', "Zoë", 'two words' WHERE a = 12"""
    assert spark.range(1).select(text.normalize_query(F.lit(q)).alias("n")).first().n == """SELECT '?', "?", 'two words' WHERE a = ?"""


def test_variations_against_all_pairs(spark):
    import itertools
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    data = {}
    for i in range(150):
        s = " ".join(sorted(rnd.sample(words, rnd.randrange(2, 10))))
        data[("hot" if i % 3 else "cold", "ip", s)] = rnd.randrange(1, 4)
    df = spark.createDataFrame([(*k, n) for k, n in data.items()], "user_account string, source_ip string, normalized string, n long")
    got = {(r.user_account, r.source_ip, r.normalized) for r in variations(df).collect()}
    want = set()
    for a, b in itertools.product(data, data):
        if a[:2] == b[:2] and data[b] > 1:
            x, y = set(a[2].split()), set(b[2].split())
            if 0.7 <= len(x & y) / len(x | y) < 0.95:
                want.add(a)
    assert got == want


def test_cursor_loses_no_ties(spark):
    from auditloom.sources.statements import incremental_by
    df = spark.createDataFrame([(i, i // 3) for i in range(30)], "event_id long, timer long")
    seen, at = [], {"timer": -1, "event_id": -1}
    while rows := incremental_by(df, at, limit=10).collect():
        seen += [r.event_id for r in rows]
        at = {"timer": rows[-1].timer, "event_id": rows[-1].event_id}
    assert seen == list(range(30))
    assert incremental_by(df, {"timer": 2, "event_id": 7}, upto=4).count() == 7


def test_text_files_that_grow_rotate_and_shrink(spark, tmp_path):
    from auditloom.sources.tail import TextTail
    logs = tmp_path / "logs"
    logs.mkdir()
    tail = TextTail(str(logs), str(tmp_path / "state"))

    def poll(k):
        return sorted((r.file.rsplit("/", 1)[1], r.pos, r.value) for r in tail.poll(spark, k).collect())

    (logs / "a.log").write_bytes(b"one\r\ntwo\nhal")
    (logs / "b.log").write_bytes("é\n".encode())
    assert poll(0) == [("a.log", 0, "one"), ("a.log", 5, "two"), ("b.log", 0, "é")]
    assert poll(1) == []
    (logs / "a.log").write_bytes(b"one\r\ntwo\nhalf\n\nfive\n")          # grows; the open line is read when it is whole
    (logs / "c.log").write_bytes(b"new\n")
    assert poll(2) == [("a.log", 9, "half"), ("a.log", 14, ""), ("a.log", 15, "five"), ("c.log", 0, "new")]
    assert poll(2) == [("a.log", 9, "half"), ("a.log", 14, ""), ("a.log", 15, "five"), ("c.log", 0, "new")]  # a repeated poll
    (logs / "a.log").write_bytes(b"after\n")                                # rotated: shorter than what was read
    (logs / "b.log").unlink()
    assert poll(3) == [("a.log", 0, "after")]
    assert poll(4) == []
