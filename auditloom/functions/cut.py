"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """The frame written once and read back.

    It cuts the lineage, survives lost executors, is computed only once however often it is read, and
    gives the planner its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_sized(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, with the bytes of the written files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    return spark.read.schema(df.schema).parquet(path), int(size)
