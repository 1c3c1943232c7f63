"""Point-in-time features: as-of aggregates, band joins on event time, panels, gaps and sequential statistics.

Time columns are long microseconds. Nothing looks at or after the moment it describes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

HOUR, DAY = 3_600_000_000, 86_400_000_000


def daily_totals(events: DataFrame, keys: Sequence[str], t: str, sums: Mapping[str, Column]) -> DataFrame:
    """keys, day (number of days since the epoch) and sums of each day that has events."""
    return events.groupBy(*keys, F.floor(F.col(t) / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def asof_state(events: DataFrame, keys: Sequence[str], t: str, value: Column, *, lag_days: int = 1, decay: float = 0.05) -> DataFrame:
    """For each key and snapshot day D: count, sum and decayed sum of what happened before D - lag_days at 0:00.

    Events are first summed by day; a decayed sum is the window sum of values that grow by e^decay a day, scaled
    back at the snapshot, with days counted from the first one so that nothing overflows over a few decades.
    """
    days = daily_totals(events, keys, t, {"total": value})
    bounds = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = days.select(*keys).distinct().crossJoin(F.broadcast(bounds)).select(*keys, "first", F.explode(F.sequence("first", "last")).alias("day"))
    filled = grid.join(days, [*keys, "day"], "left")
    until = W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, -(lag_days + 1))
    age = (F.col("day") - F.col("first")) * decay
    return filled.select(
        *keys,
        "day",
        F.coalesce(F.sum("n").over(until), F.lit(0)).alias("asof_count"),
        F.coalesce(F.sum("total").over(until), F.lit(0.0)).alias("asof_total"),
        (F.coalesce(F.sum(F.col("total") * F.exp(age)).over(until), F.lit(0.0)) * F.exp(-age)).alias("asof_decayed"),
    )


def lookback(events: DataFrame, keys: Sequence[str], t: str, hours: Sequence[int], mark: Column) -> DataFrame:
    """events with count and summed mark of the same key in the last h hours, strictly before the event.

    An event enters after its time and leaves h hours later, so what holds at a time is the sum of all changes before it.
    Rows are dealt by ranges of key and time: a task sums its range, and where a key spans several, the sums of its earlier
    ranges are added. Events without a time count each other.
    """
    fields = events.columns
    names = [f"{what}_{h}h" for h in hours for what in ("count", "mark")]
    plain = events.withColumn("mark__", F.coalesce(mark.cast("double"), F.lit(0.0)))
    known = plain.where(F.col(t).isNotNull())
    entering = known.select("*", F.lit(True).alias("event__"), *[c.alias(n) for n, c in zip(names, [F.lit(1).cast("long"), F.col("mark__")] * len(hours), strict=True)])
    rows = entering.drop("mark__")
    for h in hours:
        gone = {f"count_{h}h": F.lit(-1).cast("long"), f"mark_{h}h": -F.col("mark__")}
        leaving = known.select(*keys, (F.col(t) + h * HOUR).alias(t), F.lit(False).alias("event__"), *[gone.get(n, F.lit(0).cast("long" if n.startswith("count") else "double")).alias(n) for n in names], "mark__")
        # those that leave at one time are one change
        rows = rows.unionByName(leaving.groupBy(*keys, t, "event__").agg(*[F.sum(n).alias(n) for n in names]), allowMissingColumns=True)
    ranged = written(rows.repartitionByRange(*keys, t).withColumn("part__", F.spark_partition_id()), "lookback")
    ends = ranged.groupBy(*keys, "part__").agg(*[F.sum(n).alias(f"{n}__end") for n in names])
    earlier = W.partitionBy(*keys).orderBy("part__").rowsBetween(W.unboundedPreceding, -1)
    # a key has a row for each range that it lies in; most keys lie in one
    carried = ends.select(*[F.col(k).alias(f"{k}__key") for k in keys], F.col("part__").alias("at__"), *[F.sum(f"{n}__end").over(earlier).alias(f"{n}__before") for n in names]).where(F.col(f"{names[0]}__before").isNotNull())
    here = W.partitionBy(*keys, "part__").orderBy(t).rangeBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({n: F.sum(n).over(here) for n in names}).where("event__")
    same = F.col("part__") == F.col("at__")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}__key"))
    none = lambda n: F.lit(0).cast("long") if n.startswith("count") else F.lit(0.0)
    out = summed.join(carried, same, "left").select(*fields, *[(F.coalesce(n, none(n)) + F.coalesce(f"{n}__before", none(n))).alias(n) for n in names])
    peers = W.partitionBy(*keys)
    timeless = plain.where(F.col(t).isNull()).select(*fields, *[(F.count(F.lit(1)) if n.startswith("count") else F.sum("mark__")).over(peers).alias(n) for n in names])
    return out.unionByName(timeless)


def hourly_panel(events: DataFrame, key: str, t: str, mark: Column, lookbacks: Sequence[int] = (1, 4, 24), horizons: Sequence[int] = (3, 6, 9)) -> DataFrame:
    """A row for each key and hour with counts and marks looking back and counts ahead.

    Events are summed by hour first (an event counts for the hour that ends after it), so all windows run over
    the grid. Counts ahead are null where the horizon passes the last hour. Back: (T - h, T); ahead: [T, T + h).
    """
    hour = F.floor(F.col(t) / HOUR)
    sums = events.groupBy(key, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("m"))
    span = sums.agg(F.min("hour").alias("low"), (F.max("hour") + 1).alias("high"))
    grid = sums.select(key).distinct().crossJoin(F.broadcast(span)).select(key, "high", F.explode(F.sequence("low", "high")).alias("hour"))
    panel = grid.join(sums, [key, "hour"], "left").fillna(0, ["n"]).fillna(0.0, ["m"])
    order = W.partitionBy(key).orderBy("hour")
    columns = {}
    for h in lookbacks:
        back = order.rowsBetween(-h, -1)
        columns |= {f"count_{h}h": F.coalesce(F.sum("n").over(back), F.lit(0)), f"burden_{h}h": F.coalesce(F.sum("m").over(back), F.lit(0.0))}
    for h in horizons:
        ahead = F.sum("n").over(order.rowsBetween(0, h - 1))
        columns |= {f"Y_count_{h}h": F.when(F.col("hour") + h <= F.col("high"), ahead)}
    panel = panel.withColumns(columns).withColumns({f"Y_bin_{h}h": (F.col(f"Y_count_{h}h") > 0).cast("int") for h in horizons})
    return panel.drop("high")


def burstiness(events: DataFrame, keys: Sequence[str], t: str, hours: int = 24) -> DataFrame:
    """Deviation over mean of the gaps within the last hours before each key's last event; 0 with fewer than two."""
    part = W.partitionBy(*keys)
    recent = events.withColumn("last_t", F.max(t).over(part)).where(F.col(t) >= F.col("last_t") - hours * HOUR)
    gaps = recent.withColumn("gap", (F.col(t) - F.lag(t).over(part.orderBy(t, "event_id"))) / F.lit(float(HOUR)))
    cv = F.stddev_samp("gap") / (F.avg("gap") + 1e-6)
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count("gap") >= 2, cv).otherwise(0.0).alias("burstiness"))


def page_hinkley(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, mean: str, delta: float = 0.02, threshold: float = 5.0) -> DataFrame:
    """rows with ph (running sum of x - mean - delta over its running minimum, which starts at 0) and alert."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("ph_sum", F.sum(F.col(x) - F.col(mean) - delta).over(w))
    out = out.withColumn("ph", F.col("ph_sum") - F.least(F.lit(0.0), F.min("ph_sum").over(w)))
    return out.withColumn("alert", F.col("ph") > threshold)


def ewma(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, rate: float = 0.2) -> DataFrame:
    """keys, n and the last exponentially weighted mean: the weights of a window sum, in rows counted from the end,
    which no length makes overflow. Starts at the first value."""
    last = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    first = W.partitionBy(*keys)
    aged = rows.withColumn("age", F.row_number().over(last) - 1).withColumn("size", F.count(F.lit(1)).over(first))
    weight = F.when(F.col("age") == F.col("size") - 1, F.pow(F.lit(1 - rate), F.col("age"))).otherwise(rate * F.pow(F.lit(1 - rate), F.col("age")))
    return aged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col(x)).alias("ewma"))


def half_life_days(rows: DataFrame, day: str, value: str, least: int = 1, most: int = 180, default: int = 30, lags: int = 60) -> DataFrame:
    """The first lag, in observed days, whose autocorrelation is below one half."""
    numbered = rows.withColumn("i", F.row_number().over(W.orderBy(day))).select("i", F.col(value).alias("x"))
    shifted = numbered.crossJoin(F.broadcast(rows.sparkSession.range(1, lags + 1).withColumnRenamed("id", "lag"))).select("lag", (F.col("i") + F.col("lag")).alias("i"), F.col("x").alias("y"))
    corr = shifted.join(numbered, "i").groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return corr.agg(F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), F.min(F.when(F.col("r") < 0.5, F.col("lag"))))), F.lit(default)).alias("half_life"))
