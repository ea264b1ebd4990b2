"""Every query with a SQL twin matches DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_harness import compare, duck

ORACLES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, con, name):
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SMALL)
    assert info["ok"], info


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) >= {"score_label", "customers"}


def test_every_query_has_callable():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 100
