"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry_points
from evalgrid.plans import catalog
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
# Its figures are those of random_baseline_tuples, with intervals.
WITHOUT_SQL = {"random_baseline_accuracy"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 3 and "conf95" in df.columns
