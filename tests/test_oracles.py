"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import TESTDATA, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    shape = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in shape and "NestedLoop" not in shape
    assert difference(df, ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["day", "debits", "credits", "count"] and rows.count() > 0
