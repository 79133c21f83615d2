"""One-row truth table of the row rules: a neutral row fires nothing, one change fires one rule."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from auditloom.config import RuleConfig, ServiceAccount
from auditloom.operators import detect as D
from auditloom.operators import rules as R
from auditloom.schema import conform

CFG = RuleConfig(hr_authorized_users=("hr_1",), sensitive_allowed_users=("clerk",))
NEUTRAL = dict(event_id=1, timestamp=dt.datetime(2024, 1, 10, 12), user="app", client_ip="10.0.0.1", database="shop", query="SELECT a FROM b",
               event_name="statement/sql/select", query_entropy=3.0, execution_time_ms=1.0, cpu_time_ms=1.0, lock_time_ms=1.0, rows_returned=10,
               rows_examined=100, rows_affected=0, error_code=0, warning_count=0, created_tmp_disk_tables=0, no_index_used=0, select_full_join=0,
               is_system_table=0, has_comment=0, program_name="app", connection_type="Socket")
CASES = [
    ("r05", dict(query="grant all on x"), True), ("r05", dict(query="GRANT ALL on x", user="root"), False),
    ("r06", dict(query="SELECT 1 FROM hr_db.x"), True), ("r06", dict(query="SELECT 1 FROM hr_db.x", user="clerk"), False),
    ("r06", dict(query="SELECT 1 FROM HR_DB.x"), False), ("r06", dict(query="SELECT 1 FROM hr_db.x", user="clerk", timestamp=dt.datetime(2024, 1, 10, 17)), True),
    ("r06", dict(query="SELECT 1 FROM hr_db.x", user="clerk", timestamp=dt.datetime(2024, 1, 10, 8)), False),
    ("r08", dict(query="create user 'x1'"), True), ("r08", dict(query="CREATE USER hr_1"), False),
    ("r09", dict(is_system_table=1, query="UPDATE x"), True), ("r09", dict(is_system_table=1, query="  show x"), False),
    ("r10", dict(user="root", connection_type="TCP/IP"), True), ("r10", dict(user="root"), False),
    ("r11", dict(query="a union select b"), True), ("r11", dict(query="select 1.e(1)"), True), ("r11", dict(query="select 1xe(1)"), False),
    ("r12", dict(execution_time_ms=5000.0), False), ("r12", dict(execution_time_ms=5000.1), True), ("r13", dict(cpu_time_ms=1000.5), True),
    ("r14", dict(rows_examined=1001, rows_returned=10), True), ("r14", dict(rows_examined=1000, rows_returned=0), False), ("r14", dict(rows_examined=2000, rows_returned=20), False),
    ("r15", dict(query="set global x=1"), True), ("r16", dict(query_entropy=4.81), True), ("r16", dict(query_entropy=4.8), False),
    ("r17", dict(program_name="python-requests/2"), True), ("r18", dict(created_tmp_disk_tables=1), True),
    ("r19", dict(no_index_used=1, rows_examined=1001, rows_returned=500), True), ("r19", dict(select_full_join=1, rows_examined=1000), False),
    ("r20", dict(lock_time_ms=500.5), True), ("r21", dict(has_comment=1), True), ("r21", dict(has_comment=1, is_system_table=1), False),
    ("r22", dict(warning_count=6), True), ("r22", dict(warning_count=5), False), ("r23", dict(query="x PASSWORD_EXPIRED"), True), ("r24", dict(query="a->>b"), True),
    ("r25", dict(event_name="statement/sql/delete", rows_affected=501), True), ("r25", dict(event_name="statement/sql/update", rows_affected=501), False),
    ("r26", dict(query="x 2020"), True), ("r27", dict(query="FROM Customers", rows_returned=1001), True), ("r27", dict(query="FROM Customers", rows_returned=1000), False),
    ("r28", dict(query="DELETE audit_log", event_name="statement/sql/delete"), True), ("r28", dict(query="SELECT history"), False), ("r29", dict(query="create  view x"), True),
]


def test_row_rules(spark):
    rows = [Row(**{**NEUTRAL, **change, "event_id": i}) for i, (_, change, _) in enumerate(CASES)] + [Row(**{**NEUTRAL, "event_id": 999})]
    out = {r.event_id: r for r in R.with_row_rules(R.with_entropy(conform(spark.createDataFrame(rows))), CFG).collect()}
    for i, (key, change, expected) in enumerate(CASES):
        assert out[i][key] is expected, (key, change)
    assert not any(out[999][r.key] for r in R.RULES if r.predicate)


def _at(day, h, m=0, s=0):
    return dt.datetime(2024, 1, day, h, m, s)


def test_overtime(spark):
    rows = [(1, "a", "1.1.1.1", _at(1, 22)), (2, "a", "1.1.1.1", _at(1, 21, 59, 59)), (3, "a", "1.1.1.1", _at(2, 5)), (4, "a", "1.1.1.1", _at(2, 5, 0, 1)),
            (5, "b", "1.1.1.1", _at(3, 23)), (6, "b", "2.2.2.2", _at(3, 23)), (7, "b", "1.1.1.1", _at(3, 1)), (8, "c", "1.1.1.1", _at(4, 23, 30)), (9, "c", "1.1.1.1", _at(4, 22, 30))]
    df = spark.createDataFrame(rows, "event_id long, user string, client_ip string, timestamp timestamp")
    ot = spark.createDataFrame([("b", dt.date(2024, 1, 3), "22:30", "02:00", " 1.1.1.1 "), ("c", dt.date(2024, 1, 4), "23:00:00", "23:59:59", None)],
                               "user string, date date, start string, end string, ip string")
    assert sorted(r.event_id for r in R.late_night(df, ot, RuleConfig()).collect()) == [1, 3, 6, 9]
    cfg = RuleConfig(service_accounts={"b": ServiceAccount(("1.1.1.1",), tuple(range(8, 18))), "c": ServiceAccount(("1.1.1.1",), (9,))})
    # The calendar excuses the hour, never the address; the service rule ignores the ticket's address.
    assert sorted(r.event_id for r in R.service_account_misuse(df, ot, cfg).collect()) == [6, 9]


def test_impossible_travel(spark):
    geo = spark.createDataFrame([(16843009, 16843009, 0.0, 0.0), (33686018, 33686018, 0.0, 0.44), (50529027, 50529027, 40.0, 100.0)], "start_num long, end_num long, lat double, lon double")
    ips = {"home": "1.1.1.1", "near": "2.2.2.2", "far": "3.3.3.3", "local": "127.0.0.1"}
    steps = [("u", "home", _at(1, 1)), ("u", "near", _at(1, 1, 0, 1)), ("v", "home", _at(1, 1)), ("v", "local", _at(1, 1, 30)), ("v", "far", _at(1, 2)),
             ("w", "home", _at(1, 1)), ("w", "far", _at(1, 1)), ("x", "home", _at(1, 1)), ("x", "far", _at(5, 1))]
    df = spark.createDataFrame([(i, u, ips[p], t) for i, (u, p, t) in enumerate(steps)], "event_id long, user string, client_ip string, timestamp timestamp")
    # Near places, equal times and slow journeys are fine; an address without place does not break the journey.
    assert [r.event_id for r in R.impossible_travel(df, geo, RuleConfig()).collect()] == [4]


def test_labels_follow_rule_order(spark):
    row = {**NEUTRAL, "query": "SET GLOBAL x -- y", "execution_time_ms": 9000.0}
    logs = D.detect(conform(spark.createDataFrame([Row(**row)])), CFG).logs.first()
    assert logs["rule_TECHNICAL_ATTACK"] == "SQL Injection; DoS / Resource Exhaustion; Config Change"
    assert logs["rule_INSIDER_THREAT"] == "Admin Privilege Abuse"
    assert logs["unusual_activity_reason"] == logs["rule_TECHNICAL_ATTACK"] and logs["is_anomaly"]


def test_settings_merge():
    cfg = RuleConfig().merged({"security_rules": {"thresholds": {"mass_deletion_rows": 7}, "signatures": {"sqli_keywords": ["X"]},
                                                  "service_accounts": {"s": {"allowed_ips": ["1"], "allowed_hours": [3]}}}})
    assert (cfg.mass_deletion_rows, cfg.sqli_keywords, cfg.service_accounts["s"].allowed_hours) == (7, ("X",), (3,))
    assert cfg.lock_time_limit_ms == RuleConfig().lock_time_limit_ms
