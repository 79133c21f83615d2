"""Folders of micro-batches. A batch owns its folder, so a repeated batch writes the same files again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent write: a batch owns its folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The batches that wrote to a path."""
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def written(spark: SparkSession, path: str, since: int = 0, until: int | None = None) -> DataFrame | None:
    """What the batches (from ``since`` up to but not ``until``) wrote, with ``batch_id``; None if nothing yet."""
    ids = [b for b in batch_ids(spark, path) if b >= since and (until is None or b < until)]
    if not ids:
        return None
    if since == 0 and until is None:
        return spark.read.option("basePath", path).parquet(path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={b}" for b in ids])


def before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before wrote; None for the first batch."""
    return None if batch_id == 0 else spark.read.parquet(f"{path}/batch_id={batch_id - 1}")


def forget(spark: SparkSession, paths: Iterable[str], batch_id: int) -> None:
    """Remove state that no batch reads again: a batch reads the one before it, so that one and this one stay."""
    for path in paths:
        for b in batch_ids(spark, path):
            if b < batch_id - 1:
                fs, p = _folder(spark, f"{path}/batch_id={b}")
                fs.delete(p, True)
