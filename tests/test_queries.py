"""Every query against its SQL; queries without SQL give rows with a stable schema."""

import os

import pytest

from siltstone.plans import all as catalogue

from .checks import DATA, assert_same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns == catalogue.QUERIES[name](spark, DATA).columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["projected_scan"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in plan
