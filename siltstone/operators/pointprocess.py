"""Self-exciting activity: kernel sums, intensities, likelihoods for given parameters, and fits by zone."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.temporal import HOUR
from siltstone.sources.scratch import written

#: A kernel below e^-KERNEL_END is left out: windows reach KERNEL_END / beta hours back.
KERNEL_END = 30.0
FIT = "key string, n long, mu double, alpha double, beta double, ll double"


def kernel_sum(events: DataFrame, key: str, t: str, mark: Column, beta: float) -> DataFrame:
    """events with A = sum over earlier events of the key of mark * exp(-beta * hours between).

    Exponentials are taken relative to blocks of KERNEL_END / (2 beta) hours: within a block, and from the two
    blocks before it, no exponent leaves the range of a double, however long the series is.
    """
    block = KERNEL_END / (2 * beta)
    hours = events.withColumn("h", F.col(t) / F.lit(float(HOUR))).withColumn("m", mark)
    b = hours.withColumn("block", F.floor(F.col("h") / block)).withColumn("from_start", F.col("h") - F.col("block") * block)
    b = b.withColumn("grown", F.col("m") * F.exp(beta * F.col("from_start")))
    here = W.partitionBy(key, "block").orderBy(t).rangeBetween(W.unboundedPreceding, -1)
    totals = b.groupBy(key, "block").agg(F.sum("grown").alias("total"))
    earlier = [totals.select(key, (F.col("block") + k).alias("block"), (F.col("total") * math.exp(-beta * k * block)).alias(f"earlier{k}")) for k in (1, 2)]
    out = b.withColumn("own", F.coalesce(F.sum("grown").over(here), F.lit(0.0)))
    for side in earlier:
        out = out.join(side, [key, "block"], "left")
    total = F.col("own") + F.coalesce("earlier1", F.lit(0.0)) + F.coalesce("earlier2", F.lit(0.0))
    return out.withColumn("A", F.exp(-beta * F.col("from_start")) * total).drop("block", "from_start", "grown", "own", "earlier1", "earlier2")


def grid_intensity(events: DataFrame, key: str, t: str, mark: Column, beta: float, hours: int) -> DataFrame:
    """key, hour, A: on every hour from the first to the one after the last, the sum over the key's events of the `hours`
    hours before it of mark * exp(-beta * hours since).

    Events are summed by hour, each decayed to its hour's end, so that windows run over the grid and have `hours` rows."""
    at = F.col(t) / F.lit(float(HOUR))
    hour = F.floor(at)
    sums = events.withColumn("hour", hour).groupBy(key, "hour").agg(F.sum(mark * F.exp(-beta * (F.col("hour") + 1 - at))).alias("m"))
    span = sums.agg(F.min("hour").alias("low"), (F.max("hour") + 1).alias("high"))
    grid = sums.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("low", "high")).alias("hour"))
    before = W.partitionBy(key).orderBy("hour").rowsBetween(-hours, -1)
    cells = grid.join(sums, [key, "hour"], "left").withColumn("cells", F.collect_list(F.struct("hour", F.coalesce("m", F.lit(0.0)).alias("m"))).over(before))
    decayed = F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["m"] * F.exp(-beta * (F.col("hour") - 1 - c["hour"])))
    return cells.select(key, "hour", decayed.alias("A"))


def hawkes_likelihood(kernel: DataFrame, key: str, mu: float, alpha: float, beta: float) -> DataFrame:
    """key, n, span and log-likelihoods of the marked Hawkes and the Poisson model, and the test between them.

    kernel is kernel_sum's result. The survival function of chi square with 2 degrees of freedom is e^(-x/2).
    """
    span = kernel.agg(F.min("h").alias("start"), F.max("h").alias("stop"))
    rows = kernel.crossJoin(F.broadcast(span))
    rate = F.lit(mu) + alpha * F.col("A")
    grown = F.sum(F.col("m") * (1 - F.exp(-beta * (F.col("stop") - F.col("h")))))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("stop") - F.col("start")).alias("span"), F.sum(F.log(rate)).alias("log_rates"), grown.alias("grown"))
    hawkes = F.col("log_rates") - mu * F.col("span") - alpha / beta * F.col("grown")
    poisson = F.col("n") * F.log(F.col("n") / F.col("span")) - F.col("n")
    out = out.withColumns({"ll_hawkes": hawkes, "ll_poisson": poisson}).withColumn("lr", F.greatest(F.lit(0.0), 2 * (F.col("ll_hawkes") - F.col("ll_poisson"))))
    return out.withColumn("p_value", F.exp(-F.col("lr") / 2)).select(key, "n", "span", "ll_hawkes", "ll_poisson", "lr", "p_value")


def excitation(source: DataFrame, receivers: DataFrame, edges: DataFrame, t: str, mark: Column, beta: float) -> DataFrame:
    """event_id and, summed over a receiver's source zones, the kernel of source events strictly before it.

    Sources are summed by hour and zone, which bounds the band join by hours, not events; a source counts from
    the end of its hour.
    """
    reach = int(KERNEL_END / beta) + 1
    hourly = source.groupBy(F.col("zone").alias("source_zone"), F.floor(F.col(t) / HOUR).alias("source_hour")).agg(F.sum(mark).alias("mark"))
    asked = receivers.select("event_id", F.col("zone").alias("receiver_zone"), F.floor(F.col(t) / HOUR).alias("hour"))
    near = hourly.join(F.broadcast(edges), "source_zone")
    # one row for each hour that a source still reaches, in buckets of `reach` hours
    cells = near.withColumn("bucket", F.explode(F.array(F.floor(F.col("source_hour") / reach), F.floor(F.col("source_hour") / reach) + 1)))
    joined = asked.withColumn("bucket", F.floor(F.col("hour") / reach)).join(cells, ["receiver_zone", "bucket"], "left")
    gap = F.col("hour") - F.col("source_hour")
    return joined.groupBy("event_id").agg(F.coalesce(F.sum(F.when((gap >= 1) & (gap <= reach), F.col("mark") * F.exp(-beta * (gap - 1)))), F.lit(0.0)).alias("excitation"))


def _sorted_sums(betas: np.ndarray):
    """Rows in order of time, one run of a key after the other, with A of each rate over the earlier rows of the
    run in the same part; ties count in the order in which they come."""

    def within(h: np.ndarray, start: np.ndarray, at: float) -> np.ndarray:
        """Sums before each of some times of one key, from those at a time before them. Blocks of time are so short that no
        exponent in them leaves the range of a double."""
        out = np.empty((len(h), len(betas)))
        for b, beta in enumerate(betas):
            block = np.floor((h - at) * beta / 300.0)
            edges = np.flatnonzero(np.diff(block, prepend=-1.0, append=np.inf))
            carry, since = start[b], at
            for x, y in zip(edges, edges[1:]):
                grown = np.exp(beta * (h[x:y] - h[x]))
                into = carry * np.exp(-beta * (h[x] - since))
                before = np.cumsum(grown) - grown
                out[x:y, b] = (into + before) / grown
                carry, since = out[y - 1, b] + 1, h[y - 1]
        return out

    def run(frames):
        part, last_key, last_h, a = TaskContext.get().partitionId(), object(), 0.0, np.zeros(len(betas))
        for frame in frames:
            keys, h = frame["key"].to_numpy(object), frame["h"].to_numpy()
            sums = np.empty((len(h), len(betas)))
            edges = np.flatnonzero(np.append(np.append(True, keys[1:] != keys[:-1]), True)) if len(h) else []
            for x, y in zip(edges, edges[1:]):
                # a key's first row here starts at 0; what came in earlier parts is added later
                start, at = (a, last_h) if keys[x] == last_key else (np.zeros(len(betas)), h[x])
                sums[x:y] = within(h[x:y], start, at)
                a, last_key, last_h = sums[y - 1] + 1, keys[x], h[y - 1]
            yield pd.DataFrame({"part": part, "key": keys, "h": h, "sums": list(sums)})

    return run


def fit_hawkes(events: DataFrame, key: str, t: str, betas: Sequence[float] = tuple(np.logspace(-2, 1, 13)), rounds: int = 60) -> DataFrame:
    """key, n, mu, alpha, beta, ll: the best fit over a grid of decay rates.

    At the top for a given rate mu * span + alpha * sum of the kernels' reach is n, which leaves a concave function of
    alpha: Newton steps within a bracket find its top in a few rounds. Events are dealt by ranges of key and time, so a
    key may span any number of tasks; from one to the next only the sums at its end are carried. A round is one
    aggregate over all rows for all rates, and rounds end when no fit gains any more; the driver holds a few
    parameters for each key and rate and a few sums for each key and part.
    """
    spark, rates = events.sparkSession, np.array(betas, float)
    rows = events.select(F.col(key).cast("string").alias("key"), (F.col(t) / F.lit(float(HOUR))).alias("h")).where("h is not null")
    ranged = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    local = written(ranged.mapInPandas(_sorted_sums(rates), "part int, key string, h double, sums array<double>"), "hawkes_local")

    # the sums right after a part's last event of a key, carried on to the key's later parts
    ends = local.groupBy("key", "part").agg(F.min("h").alias("start"), F.max("h").alias("stop"), F.count(F.lit(1)).alias("n"), *[F.max_by(F.col("sums")[b], F.struct("h", F.col("sums")[b])).alias(f"s{b}") for b in range(len(rates))])
    carried, spans, before = [], {}, {}
    for r in sorted(ends.collect(), key=lambda r: (r["key"] is not None, r["key"] or "", r["start"], r["part"])):
        k = r["key"]
        at, total = before.get(k, (r["start"], np.zeros(len(rates))))
        into = total * np.exp(-rates * (r["start"] - at))
        carried.append((k, r["part"], r["start"], [float(x) for x in into]))
        end = np.array([r[f"s{b}"] for b in range(len(rates))]) + 1 + into * np.exp(-rates * (r["stop"] - r["start"]))
        before[k] = (r["stop"], end)
        lo, hi, n = spans.get(k, (r["start"], r["stop"], 0))
        spans[k] = (lo, max(hi, r["stop"]), n + r["n"])
    if not spans:
        return spark.createDataFrame([], FIT)
    carry = F.broadcast(spark.createDataFrame(carried, "key string, part int, start double, carried array<double>").withColumnRenamed("key", "k").withColumnRenamed("part", "p"))
    whole = local.join(carry, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    a = F.array(*[F.col("sums")[b] + F.col("carried")[b] * F.exp(-float(rate) * (F.col("h") - F.col("start"))) for b, rate in enumerate(rates)])
    whole = written(whole.select("key", "h", a.alias("a")), "hawkes_sums")

    def totals(x: dict, y: dict, expressions) -> dict:
        """By key, sums over its rows of expressions of x and y, which are given by key and rate, of the kernel sums and of
        the hours. Batches are summed where they are; a row for each sum leaves a task."""
        given = spark.sparkContext.broadcast({k: (x[k], y[k]) for k in x})

        def run(batches):
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                keys, h = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                a = batch.column(2).flatten().to_numpy().reshape(len(h), -1)
                edges = np.flatnonzero(np.append(np.append(True, keys[1:] != keys[:-1]), True)) if len(h) else []
                for i, j in zip(edges, edges[1:]):
                    if keys[i] in given.value:
                        found = expressions(*given.value[keys[i]], a[i:j], h[i:j, None])
                        sums[keys[i]] = sums.get(keys[i], 0.0) + np.array([e.sum(axis=0) for e in found])
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * v.size, pa.string()), pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel())], names=["key", "slot", "value"])

        out: dict = {}
        for k, slot, value in whole.mapInArrow(run, "key string, slot int, value double").groupBy("key", "slot").agg(F.sum("value")).collect():
            out.setdefault(k, {})[slot] = value
        return {k: np.array([v[i] for i in range(len(v))]).reshape(-1, len(rates)) for k, v in out.items()}

    every = {k: np.full(len(rates), hi) for k, (_, hi, _) in spans.items()}
    span = {k: max(hi - lo, 1e-9) for k, (lo, hi, _) in spans.items()}
    reach = {k: g[0] / rates for k, g in totals(every, {k: rates for k in spans}, lambda x, y, a, h: [1 - np.exp(-y * (x - h))]).items()}
    count = {k: n for k, (_, _, n) in spans.items()}

    def parts(mu, alpha, a, h):
        rate = mu + alpha * a
        return [np.log(rate), a / rate, 1 / rate, (a / rate) ** 2, a / rate / rate, 1 / rate / rate]

    # how fast the rate of an event grows with alpha, as mu falls with it
    grows = {k: reach[k] / span[k] for k in spans}
    alpha, low, high = {k: np.zeros(len(rates)) for k in spans}, {k: np.zeros(len(rates)) for k in spans}, {k: count[k] / np.maximum(reach[k], 1e-12) for k in spans}
    top, going = {}, dict.fromkeys(spans)
    for _ in range(rounds):
        mu = {k: (count[k] - alpha[k] * reach[k]) / span[k] for k in going}
        sums = totals(mu, {k: alpha[k] for k in going}, parts)
        for k, (log, a, one, aa, a1, one2) in sums.items():
            g, x = grows[k], alpha[k]
            slope, bend = a - g * one, np.maximum(aa - 2 * g * a1 + g * g * one2, 1e-300)
            top[k] = log - count[k], mu[k], x.copy()
            low[k], high[k] = np.where(slope > 0, x, low[k]), np.where(slope > 0, high[k], x)
            step = x + slope / bend
            done = (slope * slope / bend < 1e-9) | (high[k] - low[k] <= 1e-9 * high[k]) | ((x == 0) & (slope <= 0))
            alpha[k] = np.where(done, x, np.where((step > low[k]) & (step < high[k]), step, (low[k] + high[k]) / 2))
            if done.all():
                del going[k]
        if not going:
            break

    out = []
    for k, n in count.items():
        found = (math.log(n / span[k]) * n - n, n / span[k], 0.0, rates[0])
        for ll, m, al, beta in zip(*top[k], rates, strict=True):
            if ll > found[0]:
                found = (ll, m, al, beta)
        out.append((k, int(n), *[float(x) for x in (found[1], found[2], found[3], found[0])]))
    return spark.createDataFrame(out, FIT)


def rescaling_test(kernel: DataFrame, key: str, mu: float, alpha: float, beta: float) -> DataFrame:
    """key, n, D: the Kolmogorov-Smirnov distance of the compensated gaps from the unit exponential, from 3 gaps on."""
    order = W.partitionBy(key).orderBy("h", "event_id")
    dt = F.col("h") - F.lag("h").over(order)
    before = F.lag(F.col("A") + F.col("m")).over(order)
    gap = mu * dt + alpha / beta * before * (1 - F.exp(-beta * dt))
    gaps = kernel.withColumn("gap", gap).where(F.col("gap").isNotNull())
    ranked = gaps.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy("gap", "event_id"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key)))
    cdf = 1 - F.exp(-F.col("gap"))
    d = F.max(F.greatest(F.col("i") / F.col("n") - cdf, cdf - (F.col("i") - 1) / F.col("n")))
    return ranked.groupBy(key).agg(F.first("n").alias("n"), d.alias("D")).where(F.col("n") >= 3)
