"""The learnt score on data whose odd rows are known."""

import datetime as dt

from pyspark.sql import functions as F

from auditloom.config import RuleConfig
from auditloom.operators import detect as D
from auditloom.operators import ml as M
from auditloom.operators import rules as R
from auditloom.plans import inputs
from auditloom.schema import conform

CFG = M.ModelConfig(trees=10)


def rows(spark, n=400):
    start = dt.datetime(2024, 1, 1, 9)
    odd = {k for k in range(n) if k % 50 == 49}
    data = [(k, start + dt.timedelta(seconds=20 * k), f"u{k % 2}", "10.0.0.1", "SELECT 1 FROM b", 5000.0 - k if k in odd else 10.0 + k % 5, 1) for k in range(n)]
    return odd, spark.createDataFrame(data, "event_id long, timestamp timestamp, user string, client_ip string, query string, rows_returned double, warning_count long")


def test_odd_vectors_get_labels(spark):
    odd, df = rows(spark)
    got = M.reconstruction_labels(conform(df), ["rows_returned"], M.ModelConfig(components=1, contamination=0.05)).where("label = 1").collect()
    # A sequence of five is odd with its odd row and the four behind it.
    near = {k + 2 * j for k in odd for j in range(5)}
    assert got and {r.event_id for r in got} <= near


def test_scores_reach_the_result(spark):
    _, df = rows(spark)
    plain = D.detect(conform(df), RuleConfig())
    done = M.with_scores(plain, CFG)
    logs = done.logs.select("event_id", D.caught_by_rule().alias("by_rule"), f"hit_{R.ML}", "ml_anomaly_score", "unusual_activity_reason").collect()
    assert len(logs) == 400
    assert all(r.ml_anomaly_score is not None for r in logs if not r.by_rule)
    hits = [r for r in logs if r[f"hit_{R.ML}"]]
    assert all(not r.by_rule and r.ml_anomaly_score >= CFG.min_threshold and r.unusual_activity_reason == R.ML for r in hits)
    assert done.anomalies.where(F.col("behavior_group") == R.ML).count() == len(hits)


def test_too_few_rows(spark):
    _, df = rows(spark, 20)
    plain = D.detect(conform(df), RuleConfig())
    assert M.with_scores(plain, CFG) is plain


def test_clean_rows_are_read_once_and_features_made_once(spark, monkeypatch):
    """Training and scoring share the written clean rows, and the quantile goes over written scores."""
    _, df = rows(spark)
    plain = D.detect(conform(df), RuleConfig())
    reads, plans = [], []

    class Counted(D.Detection):
        @property
        def clean(self):
            reads.append(1)
            return super().clean
    monkeypatch.setattr(inputs, "detected", lambda *a: Counted(plain.logs, plain.cfg))
    monkeypatch.setattr(M, "training_buffer", lambda clean, f=M.training_buffer: f(clean, CFG))
    monkeypatch.setattr(M, "train", lambda buffer, f=M.train: f(buffer, CFG))
    monkeypatch.setattr(M, "flag_scores", lambda scored, cfg, f=M.flag_scores: plans.append(scored._jdf.queryExecution().optimizedPlan().toString()) or f(scored, cfg))
    logs = inputs.stored(spark, "clean-once").logs
    assert logs.count() == 400 and logs.where("ml_anomaly_score is not null").count() == plain.clean.count()
    assert len(reads) == 1
    assert len(plans) == 1 and "Window" not in plans[0] and "UDF" not in plans[0]
