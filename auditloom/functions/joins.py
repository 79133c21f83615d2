"""Joins of a large log with a side that is usually small, but need not be."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.cut import written_sized

#: Bytes of Parquet up to which a side is broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of a narrow table that one task turns into statements.
TASK_ROWS = 250_000


def measured(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The side written and measured; it is broadcast only if its files have at most ``max_bytes`` bytes.

    Broadcasting spares the log a shuffle with all its statement texts. A larger side keeps the plain
    join, where the adaptive plan splits hot keys. The written table also cuts the lineage.
    """
    kept, size = written_sized(small)
    return F.broadcast(kept) if size <= max_bytes else kept


def together(spark: SparkSession, *calls: Callable[[], Any]) -> list:
    """The results of calls that each run jobs of their own, started at the same time: small jobs fill the cores that
    the tail of another leaves free."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def spread(df: DataFrame, least: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows over all cores, and at most about ``task_rows`` in one part, when the scan gives fewer parts.

    File splits are cut by compressed bytes: narrow rows that become statements may be millions to a split. Rows are counted
    from the files' footers. With enough splits nothing is added to the plan.
    """
    parts = max(least or df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / task_rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
