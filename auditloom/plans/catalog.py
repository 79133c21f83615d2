"""Registry of runnable queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None = None


class Catalog:
    """Collects queries. Output is made comparable: texts for times and lists, rounded doubles."""

    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def add(self, name: str, fn: QueryFn, sql: str | None = None, *, rnd: dict[str, int] | None = None,
            ts: tuple[str, ...] = (), arr: tuple[str, ...] = (), big: tuple[str, ...] = (),
            ints: tuple[str, ...] = ()) -> None:
        if name in self.items:
            raise ValueError(f"query {name} is registered twice")
        rnd = rnd or {}

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir), rnd)

        if sql is not None:
            edits = ([f'round("{c}", {d}) AS "{c}"' for c, d in rnd.items()]
                     + [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\"" for c in ts]
                     + [f"array_to_string(\"{c}\", ',') AS \"{c}\"" for c in arr]
                     + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in big]
                     + [f'CAST("{c}" AS INTEGER) AS "{c}"' for c in ints])
            if edits:
                sql = f"SELECT * REPLACE ({', '.join(edits)}) FROM (\n{sql}\n)"
        self.items[name] = Query(name, run, sql)


def comparable(df: DataFrame, rnd: dict[str, int]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in rnd:
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            c = F.round(c, rnd[f.name]) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)
