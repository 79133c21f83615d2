"""Input frames the registered queries share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import fixtures as X
from auditloom.functions.cut import written
from auditloom.operators import detect as D
from auditloom.operators import ml as M
from auditloom.operators import rules as R
from auditloom.operators.features import enrich
from auditloom.schema import AUDIT_SCHEMA
from auditloom.session import checkpoint_dir

CFG = X.FIXTURE_CONFIG
_detected: dict[tuple[str, str], D.Detection] = {}
_written: dict[tuple[str, str], D.Detection] = {}
_models: dict[tuple[str, str], object] = {}
_clean: dict[tuple[str, str], DataFrame] = {}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.audit_log(spark, sf_dir)


def history_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habits learnt before the split day."""
    return R.learn_profile(audit(spark, sf_dir).where(F.col("timestamp") < F.lit(X.PROFILE_SPLIT).cast("timestamp")))


def detection(spark: SparkSession, sf_dir: str) -> D.Detection:
    return D.detect(audit(spark, sf_dir), CFG, X.overtime(spark, sf_dir), X.geo_ranges(spark, sf_dir),
                    history_profile(spark, sf_dir))


def model(spark: SparkSession, sf_dir: str):
    """The learnt score's model, trained once per session; None while too few rows are clean.

    Training is a job of its own on the clean rows of the written detection result; detection scores with the model that is there.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        clean = clean_rows(spark, sf_dir).select(*AUDIT_SCHEMA.names)
        _models[key] = M.train(M.training_buffer(enrich(clean)))
    return _models[key]


def detected(spark: SparkSession, sf_dir: str) -> D.Detection:
    """The detection result without the learnt score, written once per session into the shared checkpoint folder.

    Tasks write the rows they have: no reader of it prunes days, so nothing is shuffled or sorted for them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _detected:
        path = f"{checkpoint_dir(spark)}/detected-{uuid.uuid4().hex}"
        logs = detection(spark, sf_dir).logs.withColumn("event_date", F.to_date("timestamp"))
        logs.write.parquet(path)
        _detected[key] = D.Detection(spark.read.parquet(path), CFG)
    return _detected[key]


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no rule caught, read from the whole log and written once per session for training and scores."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _clean:
        _clean[key] = written(detected(spark, sf_dir).clean)
    return _clean[key]


def stored(spark: SparkSession, sf_dir: str) -> D.Detection:
    """The written detection result, learnt score included, so read-outs do not detect again.

    The log is detected once for both training and reading; the rows that no rule caught are scored from the written table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        found, scorer = detected(spark, sf_dir), model(spark, sf_dir)
        _written[key] = found if scorer is None else M.with_scores(found, model=scorer, clean=clean_rows(spark, sf_dir))
    return _written[key]
