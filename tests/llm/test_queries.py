"""The registered queries against their SQL."""

import os

import pytest

from siltstone.llm import registry

from ..checks import DATA, assert_same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = registry.op5_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["predicted"] for r in rows if r["quality"] == 1) >= 0.99 * sum(r["quality"] for r in rows)


def test_all_are_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]
