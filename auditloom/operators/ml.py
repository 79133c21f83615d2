"""Anomaly score learnt from rows that no rule caught."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.cut import written
from auditloom.functions.quantiles import exact_percentiles
from auditloom.operators import detect as D
from auditloom.operators import rules as R
from auditloom.operators.features import enrich, sequences
from auditloom.schema import AUDIT_SCHEMA

# Columns that are never features.
EXCLUDED = ("timestamp", "event_id", "query", "normalized_query", "error_message", "is_anomaly", "ml_anomaly_score",
            "unusual_activity_reason", "analysis_type", "accessed_tables", "sensitive_access_info", "tables_touched",
            "suspicious_func_name", "privilege_cmd_name", "error_code", "behavior_group")
CATEGORICAL = ("user", "client_ip", "database", "command_type")
_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)


@dataclass(frozen=True)
class ModelConfig:
    min_train_size: int = 100
    max_buffer_size: int = 5000
    contamination: float = 0.039
    sequence_length: int = 5
    components: int = 8
    trees: int = 200
    learning_rate: float = 0.05
    depth: int = 5
    positive_weight: float = 30.03
    quantile: float = 0.99
    min_threshold: float = 0.75
    seed: int = 42


def training_buffer(clean: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """The newest clean rows; the buffer size is part of the method."""
    return clean.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(cfg.max_buffer_size)


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns of an enriched log."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in EXCLUDED]
    cat = [c for c in CATEGORICAL if c in df.columns]
    return num, cat


def indexers(cat: Sequence[str]) -> list[StringIndexer]:
    """Category codes in alphabetical order; unseen values share one extra code."""
    return [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cat]


def scaling(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (two numbers each); constant columns keep scale 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def standardize(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "_std") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})


def reconstruction_labels(df: DataFrame, cols: Sequence[str], cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Pseudo labels: rows whose last five vectors are badly explained by the main components.

    Components are orthonormal, so the squared error is the length of the vector minus the length of
    its projection; rows before a user's fifth get label 0.
    """
    params = scaling(df, cols)
    scaled = [f"{c}_std" for c in cols]
    std = standardize(df, params)
    seq = sequences(std, scaled, ("user",), cfg.sequence_length).withColumn("_flat", F.flatten("sequence"))
    vec = seq.withColumn("_vec", array_to_vector("_flat"))
    k = min(cfg.components, len(scaled) * cfg.sequence_length)
    model = PCA(k=k, inputCol="_vec", outputCol="_proj").fit(vec)

    def squares(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    mse = (squares(F.col("_flat")) - squares(vector_to_array("_proj"))) / F.lit(float(len(scaled) * cfg.sequence_length))
    err = model.transform(vec).select("event_id", F.round(mse, 9).alias("mse"))
    limit = exact_percentiles(err, [], "mse", {"t": 1.0 - cfg.contamination}).scalar()
    hits = err.where(F.col("mse") > limit).select("event_id", F.lit(1.0).alias("label"))
    return df.join(hits, "event_id", "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def train(buffer: DataFrame, cfg: ModelConfig = ModelConfig()) -> PipelineModel | None:
    """Boosted trees on pseudo labels; None while the buffer is too small."""
    # The buffer is small by definition; written once, as one part, its many short passes have one task each.
    buffer = written(buffer.coalesce(1))
    if buffer.limit(cfg.min_train_size).count() < cfg.min_train_size:
        return None
    num, cat = feature_columns(buffer)
    coded = Pipeline(stages=indexers(cat)).fit(buffer)
    labelled = reconstruction_labels(coded.transform(buffer), [*num, *[f"{c}_code" for c in cat]], cfg)
    weighted = labelled.withColumn("_w", F.when(F.col("label") == 1.0, cfg.positive_weight).otherwise(1.0))
    filled = written(weighted.fillna(0, subset=num).coalesce(1))
    codes = [s.getOutputCol() for s in coded.stages]
    stages = [VectorAssembler(inputCols=[*num, *codes], outputCol="features", handleInvalid="keep"),
              GBTClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxIter=cfg.trees, stepSize=cfg.learning_rate,
                            maxDepth=cfg.depth, maxBins=_bins(coded), seed=cfg.seed)]
    fitted = Pipeline(stages=stages).fit(filled)
    return PipelineModel([*coded.stages, *fitted.stages])


def _bins(coded: PipelineModel) -> int:
    return max(32, max((len(s.labels) for s in coded.stages), default=0) + 2)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``ml_anomaly_score``, the probability of the anomalous class."""
    num, _ = feature_columns(rows)
    return model.transform(rows.fillna(0, subset=num)).withColumn("ml_anomaly_score", vector_to_array("probability")[1])


def flag_scores(scored: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """``is_ml``: score at or above the larger of its high quantile and the fixed minimum."""
    limit = exact_percentiles(scored, [], "ml_anomaly_score", {"q": cfg.quantile}).select(
        F.greatest(F.col("q"), F.lit(cfg.min_threshold)).alias("t")).scalar()
    return scored.withColumn("is_ml", F.col("ml_anomaly_score") >= limit)


def with_scores(found: D.Detection, cfg: ModelConfig = ModelConfig(), model: PipelineModel | None = None,
                clean: DataFrame | None = None) -> D.Detection:
    """A detection result with the learnt score of the rows that no rule caught; ``clean`` are these rows if they are written already.

    Without a stored model, one is trained on the newest of these rows; while there are too few, nothing is added. Only these
    rows are written and scored; all others are passed on as they are.
    """
    clean = written(found.clean) if clean is None else clean
    rows = enrich(clean.select(*AUDIT_SCHEMA.names))
    model = model or train(training_buffer(rows, cfg), cfg)
    if model is None:
        return found
    # The quantile goes over the scores several times; features and scores are made once.
    scores = written(score(model, rows).select("event_id", "ml_anomaly_score"))
    scored = written(flag_scores(scores, cfg))
    done = D.finalize(D.apply_ml(clean.drop("ml_anomaly_score", f"hit_{R.ML}"), scored), found.cfg)
    return D.Detection(found.logs.where(D.caught_by_rule()).unionByName(done), found.cfg)


def save_model(model: PipelineModel, spark: SparkSession, path: str, features: Sequence[str], stamp: str) -> str:
    """Write the model under a version made of time and feature list; returns the version."""
    version = f"{stamp}_{hashlib.md5(json.dumps(sorted(features)).encode()).hexdigest()[:8]}"
    model.write().overwrite().save(f"{path}/{version}/model")
    spark.range(1).select(F.lit(version).alias("version"), F.array(*[F.lit(f) for f in features]).alias("features")).write.mode(
        "overwrite").json(f"{path}/{version}/metadata")
    return version


def load_model(path: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{version}/model")
