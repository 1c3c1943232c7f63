"""Streaming forms of the incident aggregates: windows under a watermark, and state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.scratch import scratch_dir


def events_stream(spark: SparkSession, folder: str, name: str = "events", files: int = 1) -> DataFrame:
    """The events table of a folder, one Parquet file or a folder of them, as a stream with ts as a timestamp.

    The path is given as a pattern, since a stream takes a path without one to be a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    pattern = f"{folder}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def events_in_order(spark: SparkSession, folder: str, name: str = "events", rows: int = 1_000_000) -> DataFrame:
    """The events table as a stream of batches of about `rows` rows, each later in ts than the ones before, so that
    no row is late, however the table's files lie. The ranges are written once; a stream takes the older files first."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    ranges = max(1, -(-table.count() // rows))
    base = f"{scratch_dir(spark)}/siltstone/ordered-{uuid.uuid4().hex}"
    table.repartitionByRange(ranges, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/{name}.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
    files.sort(key=lambda f: int(f.getPath().getName().split("-")[1]))  # a range's number
    last = max(f.getModificationTime() for f in files)
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), last - 1000 * (len(files) - 1 - i), -1)
    found = sorted((f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getModificationTime())
    if [f.getPath().getName() for f in found] != [f.getPath().getName() for f in files]:
        raise RuntimeError(f"{base}: the store does not keep times of files, by which batches are ordered")
    return events_stream(spark, base, name)


def tumbling(events: DataFrame, every: str = "7 days", start: str = "4 days", late: str = "1 day") -> DataFrame:
    """Counts and means by cause and Monday-aligned window."""
    w = F.window("ts", every, every, start)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean")


def sliding(events: DataFrame, size: str = "4 hours", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window("ts", size, every)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), (F.col("user_id") % 5).alias("zone")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "zone", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "n long, mean double, m2 double, ewma double, ph_sum double, ph_min double, alerts long"
POSTERIOR = "event_type string, n long, mean double, variance double, ewma double, alerts long"


def running_posterior(events: DataFrame, rate: float = 0.2, delta: float = 0.02, threshold: float = 5.0, centre: float = 2.0) -> DataFrame:
    """By cause, after each batch: count, mean and variance of log values, their weighted mean and drift alerts.

    The state is a few numbers a key, whatever passes; a batch's rows of a key are read in order of time."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        import numpy as np

        n, mean, m2, ewma, ph_sum, ph_min, alerts = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in np.log1p(rows["value"].to_numpy()):
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
            ewma = x if n == 1 else rate * x + (1 - rate) * ewma
            ph_sum += x - centre - delta
            ph_min = min(ph_min, ph_sum)
            alerts += int(ph_sum - ph_min > threshold)
        state.update((int(n), float(mean), float(m2), float(ewma), float(ph_sum), float(ph_min), int(alerts)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [mean], "variance": [m2 / max(1, n - 1)], "ewma": [ewma], "alerts": [alerts]})

    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(update, POSTERIOR, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows: as written for append, of each batch for update."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/siltstone/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("b")
