"""Registered queries against DuckDB on the small tables. The slow jobs have tests of their own."""

import pytest

from auditloom.plans.registry import catalog
from tests.compare import compare, connect

SLOW = {"m06_supervised_score", "m08_saved_model", "x01_micro_batch_detection", "x04_profile_state"}
NAMES = [n for n in catalog().items if n not in SLOW]


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_as_sql(spark, duck, sf_dir, name):
    result = compare(spark, duck, catalog().items[name], sf_dir)
    assert result["problems"] == []


def test_contract():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 200
