"""Pipeline stages on tables with extra columns of any name, nulls, and no rows."""

from __future__ import annotations

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
NAMES = ("_score", "_found", "_id", "_sum", "_md5", "score", "cls", "grp", "component_id", "_chunk", "bucket", "kept", "_p0", "node", "Text_")


def table(spark, rows):
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *NAMES) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_stage_keeps_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs] + [(None, None, None, None, None), (10_001, "", "en", None, 0), (10_001, "", "en", None, 0)]
    before = table(spark, rows)
    after = stage(spark, before, SF)
    assert after.schema.names == before.schema.names
    got = after.collect()
    assert 0 < len(got) <= len(rows) and all(r[n] == n for r in got for n in NAMES)
    assert stage(spark, table(spark, []), SF).count() == 0


def test_last_stage(spark):
    before = table(spark, [(1, "a b", "en", "s", 3), (2, None, None, None, None)])
    assert {r.doc_id for r in P.STAGES[-1][1](spark, before, SF).collect()} == {1, 2}
    assert P.STAGES[-1][1](spark, table(spark, []), SF).count() == 0
