"""Streams: late rows, duplicates, and state that carries over batches."""

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.streaming import jobs

START = datetime(2024, 1, 1)


def write(spark, folder, batches):
    for i, rows in enumerate(batches):
        data = [(k, START + timedelta(hours=h), u, kind, v) for k, h, u, kind, v in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    write(spark, tmp_path, [[(1, 1, 1, "a", 1.0), (2, 500, 1, "a", 3.0)], [(5, 510, 1, "a", 3.0)], [(3, 2, 1, "a", 9.0), (4, 700, 1, "a", 5.0)]])
    out = jobs.run_to_table(jobs.tumbling(jobs.events_stream(spark, str(tmp_path))), "late")
    first = out.orderBy("start_us").first()
    assert (first["n"], first["mean"]) == (1, 1.0)  # the row of hour 2 came two batches after the watermark had passed its week
    assert out.count() == 3  # the week of hour 700 is still open


def test_duplicates_within_the_watermark(spark, tmp_path):
    write(spark, tmp_path, [[(1, 1, 1, "a", 1.0), (1, 1, 1, "a", 1.0)], [(1, 1, 1, "a", 1.0), (2, 3, 1, "b", 2.0)]])
    out = jobs.run_to_table(jobs.deduplicated(jobs.events_stream(spark, str(tmp_path))).select("event_id", "event_type", "value"), "dedup")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2]


def test_state_carries_over_batches(spark, tmp_path):
    write(spark, tmp_path, [[(k, k, 1, "a", float(k)) for k in range(5)], [(k, k, 1, "a", float(k)) for k in range(5, 9)]])
    out = jobs.run_to_table(jobs.running_posterior(jobs.events_stream(spark, str(tmp_path))), "state", "update")
    last = out.orderBy(F.desc("n")).first()
    assert last["n"] == 9 and out.count() == 2


def test_queries_count_rows_of_files_out_of_order(spark, tmp_path):
    from siltstone.plans import all as catalogue

    write(spark, tmp_path, [[(9, 900, 1, "a", 1.0), (8, 600, 1, "a", 1.0)], [(10, 910, 1, "a", 1.0)], [(k, k, 1, "a", 1.0) for k in range(5)]])
    assert sum(r["n"] for r in catalogue.QUERIES["stream_tumbling"](spark, str(tmp_path)).collect()) == 6


def test_batches_come_in_order_of_time(spark, tmp_path):
    rows = [(k, 50 * k, 1, "a", float(k % 7)) for k in range(40)]
    write(spark, tmp_path, [rows[30:], rows[:10], rows[20:30], rows[10:20]])
    out = jobs.run_to_table(jobs.tumbling(jobs.events_in_order(spark, str(tmp_path), rows=5)), "ordered").collect()
    assert sum(r["n"] for r in out) > 30
    state = jobs.run_to_table(jobs.running_posterior(jobs.events_in_order(spark, str(tmp_path), rows=5)), "ordered", "update")
    ewma = None
    for *_, v in rows:
        x = math.log1p(v)
        ewma = x if ewma is None else 0.2 * x + 0.8 * ewma
    assert state.count() > 4
    last = state.orderBy(F.desc("n")).first()
    assert last["n"] == 40 and abs(last["ewma"] - ewma) < 1e-9
