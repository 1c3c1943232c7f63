"""The feature matrix on awkward rows."""

from pyspark.sql import functions as F

from siltstone.operators import asof
from siltstone.operators.temporal import DAY

SCHEMA = "event_id long, t long, event_cause string, corridor string, zone string, junction long, priority int, duration double, is_censored boolean, closure boolean, planned boolean, trust double"


def matrix(spark, rows):
    events = spark.createDataFrame(rows, SCHEMA)
    return {r["event_id"]: r for r in asof.feature_matrix(events, events).collect()}, events


def test_empty_table_gives_no_rows(spark):
    found, events = matrix(spark, [])
    assert found == {}
    assert len(asof.feature_matrix(events, events).columns) == 39


def test_sees_only_days_before_the_last(spark):
    rows = [(i, i * DAY + 1000, "a", "c", "z", 1, 1, 100.0, False, False, True, 0.5) for i in range(5)]
    found, _ = matrix(spark, rows)
    assert [found[i]["asof_corridor_event_rate"] for i in range(5)] == [0, 0, 1, 2, 3]
    assert [found[i]["asof_planned_support"] for i in range(5)] == [0, 0, 1, 2, 3]
    assert [found[i]["snapshot_date"] for i in range(3)] == ["1970-01-01", "1970-01-01", "1970-01-02"]
    assert found[1]["asof_p50_duration"] == 60 and found[2]["asof_p50_duration"] == 100
    assert found[4]["asof_retrieval_fallback"] == "exact" and found[2]["asof_retrieval_fallback"] == "low_support"


def test_nulls_and_repeated_rows(spark):
    rows = [(i, (i % 4) * DAY + 5000, None, None, None, None, None, 50.0, False, None, True, None) for i in range(8)] + [(9, 3 * DAY, "a", None, "z", 2, 1, None, False, True, False, 1.0)] * 2
    events = spark.createDataFrame(rows, SCHEMA)
    out = asof.feature_matrix(events, events)
    assert out.count() == 10
    late = out.where("event_id = 3").first()
    assert late["asof_quantile_fallback_level"] == "global" and late["asof_quantile_support"] == 4 and late["asof_p80_duration"] == 50
    assert late["asof_corridor_burden"] == 0 and late["trust_x_confidence"] == 0
    assert out.where(F.col("asof_hawkes_intensity").isNull()).count() == 0
