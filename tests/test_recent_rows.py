"""Lists of the rows before each row, across time slots, for a hot key and for ties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions.segmented import recent_rows


@pytest.mark.parametrize("depth", [1, 4])
def test_equals_a_plain_walk(spark, depth):
    rnd = random.Random(depth)
    rows = [("hot" if i % 3 else f"k{i % 4}", rnd.randrange(300), i, None if i % 17 == 0 else i * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at long, id long, v long")
    got = {r.id: [x.v for x in r.before] for r in recent_rows(df, ["key"], ["at", "id"], ["v"], F.floor(F.col("at") / 25), depth, "before").collect()}
    want, seen = {}, {}
    for key, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        own = seen.setdefault(key, [])
        want[i] = own[::-1][:depth]
        own.append(v)
    assert got == want
