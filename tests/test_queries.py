"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.oracles import oracle_queries
from checks.queries import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = all_queries(), oracle_queries()


@pytest.fixture(scope="module")
def twins():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, twins, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, twins.execute(TWINS[name]).df()) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "dominant_kind", "dominant_count", "stack", "project_summary"]
    assert df.count() == 20
