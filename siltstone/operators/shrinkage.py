"""Self-exciting rates of many keys: least squares in closed form, shrinkage to their group, intervals by weighted refits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.pointprocess import kernel_sum
from siltstone.sources.scratch import written

#: Hours of a block of time: what a refit weighs as a whole.
BLOCK = 24
#: The least share of a key's mean rate that its base rate may have, and from which on its fragility is reliable.
FLOOR, RELIABLE = 0.01, 0.05
#: Distribution function of the Poisson law with mean 1 at 0, 1, 2, ...: a weight counts the values not above a uniform number.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
SUMS = ("n", "span", "i1", "i2", "y")


def poisson_weight(*parts: Column) -> Column:
    """A weight with the Poisson law of mean 1, drawn from the MD5 digest of its parts."""
    # eight hexadecimal digits are in the order of the number that they write, so that they are compared as they are
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return reduce(lambda total, c: total + (digits >= f"{math.ceil(c * 2.0**32):08x}").cast("int"), [c for c in POISSON if math.ceil(c * 2.0**32) < 2**32], F.lit(0))


def kernel_moments(events: DataFrame, key: str, t: str, mark: Column, betas: Sequence[float], own: Column | None = None) -> DataFrame:
    """key, beta, block, n, span, i1, i2, y, now: by block of time the sums that a least-squares fit needs.

    With A(t) the sum over the key's earlier events of mark * exp(-beta * hours between): span, i1 and i2 are the integrals
    of 1, A and A^2 from one event to the next, y is the sum of A at the n events and now a block's part of A at the end. The
    time is that from the first to the last event of the table. own (0 or 1) says which events count beside adding to A;
    all do where it is not given. Events at one time do not excite each other; rows without key or time go. Windows run
    within a key's block of time, and over its blocks, so that a long series is not one task's."""
    known = events.where(F.col(key).isNotNull() & F.col(t).isNotNull())
    times = written(known.groupBy(key, t).agg(F.sum(F.lit(1) if own is None else own).alias("c"), F.sum(mark).alias("m")), "times")
    hour = F.col(t) / F.lit(3_600_000_000.0)
    ends = times.agg(F.min(hour).alias("start"), F.max(hour).alias("stop"))
    # what does not depend on the decay rate is found once: an event's block, and the time from it to the next and from the start
    k = times.withColumn("hour", hour).withColumn("block", F.floor(F.col("hour") / BLOCK))
    k = k.withColumn("next", F.lead("hour").over(W.partitionBy(key, "block").orderBy("hour")))
    series = W.partitionBy(key).orderBy("block")
    blocks = k.groupBy(key, "block").agg(F.min("hour").alias("low")).withColumns({"after": F.lead("low").over(series), "first": F.lag("low").over(series).isNull()})
    k = k.join(blocks, [key, "block"]).crossJoin(F.broadcast(ends))
    gap = F.coalesce("next", "after", "stop") - F.col("hour")
    lead_in = F.when(F.col("first") & (F.col("hour") == F.col("low")), F.col("hour") - F.col("start")).otherwise(0.0)
    spaced = written(k.select(key, t, "c", "m", F.col("block").alias("day"), gap.alias("dt"), lead_in.alias("lead_in"), (F.col("stop") - F.col("hour")).alias("left")), "spaced")
    out = []
    for beta in betas:
        grown, dt = F.col("A") + F.col("m"), F.col("dt")
        sums = kernel_sum(spaced, key, t, F.col("m"), beta).groupBy(key, F.col("day").alias("block")).agg(
            F.sum("c").cast("double").alias("n"),
            F.sum(dt + F.col("lead_in")).alias("span"),
            F.sum(grown * (1 - F.exp(-beta * dt)) / beta).alias("i1"),
            F.sum(grown * grown * (1 - F.exp(-2 * beta * dt)) / (2 * beta)).alias("i2"),
            F.sum(F.col("c") * F.col("A")).alias("y"),
            F.sum(F.col("m") * F.exp(-beta * F.col("left"))).alias("now"),
        )
        out.append(sums.withColumn("beta", F.lit(float(beta))))
    return reduce(DataFrame.unionByName, out)


def least_squares(sums: DataFrame) -> DataFrame:
    """sums with mu, alpha and gain: the rate mu + alpha * A that is nearest to the events in the mean square, with alpha
    not below 0 and mu not below FLOOR of the mean rate. gain is how much the contrast falls below that of no rate at all."""
    n, span, i1, i2, y = [F.col(c) for c in SUMS]
    det = span * i2 - i1 * i1
    free = F.when(det > 1e-12 * span * i2, (span * y - i1 * n) / det).otherwise(0.0)
    floor = FLOOR * n / span
    alpha = F.greatest(F.lit(0.0), free)
    low = (n - alpha * i1) / span < floor
    bound = F.when(i2 > 0, F.greatest(F.lit(0.0), (y - floor * i1) / i2)).otherwise(0.0)
    out = sums.where(span > 0).withColumn("alpha", F.when(low, bound).otherwise(alpha))
    out = out.withColumn("mu", F.when(low, floor).otherwise((n - F.col("alpha") * i1) / span))
    mu, alpha = F.col("mu"), F.col("alpha")
    return out.withColumn("gain", 2 * (mu * n + alpha * y) - (mu * mu * span + 2 * mu * alpha * i1 + alpha * alpha * i2))


def spread(estimates: DataFrame, group: Sequence[str], x: str, variance: str) -> DataFrame:
    """group, x_mean, x_tau: the mean and the variance between the keys of a group, from their estimates and these' variances.

    The variance is the moment estimator, not below 0; it is null where there is one key, whose estimate is the mean then."""
    w = 1 / F.col(variance)
    first = estimates.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * F.col(x)).alias("swx"), F.sum(w * F.col(x) * F.col(x)).alias("swxx"))
    q = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    tau = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("sw") - F.col("sww") / F.col("sw"))))
    between = first.select(*group, tau.alias(f"{x}_tau"))
    both = estimates.join(between, list(group)) if group else estimates.crossJoin(F.broadcast(between))
    v = 1 / (F.col(variance) + F.coalesce(f"{x}_tau", F.lit(0.0)))
    return both.groupBy(*group).agg((F.sum(v * F.col(x)) / F.sum(v)).alias(f"{x}_mean"), F.first(f"{x}_tau").alias(f"{x}_tau"))


def shrunk_rates(events: DataFrame, key: str, group: str, t: str, mark: Column, betas: Sequence[float], *, least: int = 20, draws: int = 100, strength: float | None = None, own: Column | None = None) -> DataFrame:
    """One row for each key: its base rate and excitation, shrunk to its group's, its fragility now and the interval of that.

    A key with at least `least` events is fitted by least squares; refits with Poisson weights on its blocks of time give
    the variances and the interval (5 to 95 %). Its weight against the group's mean is the share that the variance between
    keys has in that between and within; with `strength` it is n / (n + strength). Keys with fewer events take the group's
    mean, that of all keys where no key of the group is fitted, and their mean rate where none is at all; their interval is
    0.3 to 3 times the fragility. The decay rate is the one of `betas` with the largest gain over the group's fitted keys,
    else over all of its keys. A key that comes with several groups belongs to the smallest. Draws are hashes of key,
    block and number, so reruns agree. An empty table gives no rows.
    """
    groups = events.where(F.col(key).isNotNull() & F.col(t).isNotNull()).groupBy(key).agg(F.coalesce(F.min(F.col(group).cast("string")), F.lit("UNKNOWN")).alias("group"))
    moments = written(kernel_moments(events, key, t, mark, betas, own).join(groups, key), "moments")
    totals = moments.groupBy(key, "group", "beta").agg(*[F.sum(c).alias(c) for c in (*SUMS, "now")])
    fits = least_squares(totals).withColumn("fitted", F.col("n") >= least)
    gains = fits.groupBy("group", "beta").agg(F.sum(F.col("fitted").cast("int") * F.col("gain")).alias("fitted_gain"), F.sum("gain").alias("gain"))
    best = gains.groupBy("group").agg(F.min_by("beta", F.struct(-F.round("fitted_gain", 9), -F.round("gain", 9), "beta")).alias("beta"))
    fits = written(fits.join(best, ["group", "beta"]).drop("gain"), "rates")

    # dealt by key, so that a refit's sums are made where its rows lie; a weight of 0 adds nothing and is not asked for twice
    chosen = fits.where("fitted").select(key, F.col("beta").alias("chosen"))
    rows = moments.join(chosen, key).where("beta = chosen").repartition(key).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    rows = rows.withColumn("w", poisson_weight(F.col(key), F.col("block"), F.col("draw")))
    refits = written(least_squares(rows.groupBy(key, "draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS])).select(key, "draw", "mu", "alpha"), "refits")
    variances = refits.groupBy(key).agg(*[F.greatest(F.coalesce(F.var_samp(x), F.lit(0.0)), F.lit(1e-12)).alias(f"{x}_var") for x in ("mu", "alpha")])
    held = fits.join(variances, key, "left")

    known = held.where("fitted")
    out = held
    for x in ("mu", "alpha"):
        out = out.join(spread(known, ["group"], x, f"{x}_var"), "group", "left")
        out = out.crossJoin(F.broadcast(spread(known, [], x, f"{x}_var").select(F.col(f"{x}_mean").alias(f"{x}_all"))))
        own_weight = F.lit(1.0) * F.col("n") / (F.col("n") + strength) if strength is not None else F.coalesce(F.col(f"{x}_tau") / (F.col(f"{x}_tau") + F.col(f"{x}_var")), F.lit(1.0))
        out = out.withColumn(f"{x}_weight", F.when(F.col("fitted"), own_weight).otherwise(0.0))
        out = out.withColumn(f"{x}_prior", F.coalesce(f"{x}_mean", f"{x}_all", F.col("n") / F.col("span") if x == "mu" else F.lit(0.0)))

    def shrunk(x: str) -> Column:
        value = F.col(f"{x}_weight") * F.col(x) + (1 - F.col(f"{x}_weight")) * F.col(f"{x}_prior")
        return F.greatest(value, FLOOR * F.col("n") / F.col("span"), F.lit(1e-6)) if x == "mu" else value

    def fragility() -> Column:
        return shrunk("alpha") * F.col("now") / shrunk("mu")

    shares = out.select(key, "n", "span", "now", "mu_weight", "mu_prior", "alpha_weight", "alpha_prior")
    drawn = refits.join(shares, key).withColumn("drawn", fragility())
    ends = drawn.groupBy(key).agg(F.percentile("drawn", 0.05).alias("low"), F.percentile("drawn", 0.95).alias("high"))
    out = out.withColumns({"raw_mu": F.col("mu"), "raw_alpha": F.col("alpha"), "fragility": fragility(), "mu": shrunk("mu"), "alpha": shrunk("alpha")}).join(ends, key, "left")
    return out.select(
        key, "group", F.col("n").cast("long").alias("n"), F.when(F.col("fitted"), "key").otherwise("group").alias("level"), "beta", "raw_mu", "raw_alpha", "mu_weight", "alpha_weight", "mu", "alpha",
        (F.col("alpha") / F.col("beta")).alias("branching"), (F.col("mu") + F.col("alpha") * F.col("now")).alias("intensity"), "fragility", F.least("fragility", F.lit(100.0)).alias("practical"),
        F.coalesce("low", 0.3 * F.col("fragility")).alias("low"), F.coalesce("high", 3 * F.col("fragility")).alias("high"), (F.col("mu") >= RELIABLE * F.col("n") / F.col("span")).alias("reliable"),
    )


def near_events(events: DataFrame, near: DataFrame, place: str, sigma: float) -> DataFrame:
    """One row for each event and place that it reaches: centre, the event's columns, near_weight = exp(-km / sigma), and own:
    whether it happened there. near holds centre, place and km, one row a pair."""
    pairs = near.select("centre", F.col(place).alias("near_place"), "km")
    joined = events.join(pairs, F.col(place) == F.col("near_place")).drop("near_place")
    return joined.withColumn("near_weight", F.exp(-F.col("km") / sigma)).withColumn("own", (F.col("centre") == F.col(place)).cast("int")).drop("km")


def likelihood_ratio(events: DataFrame, key: str, t: str, mark: Column, rates: DataFrame, own: Column | None = None) -> DataFrame:
    """key, ll, ll_poisson, lr, p_value: fitted rates (key, beta, mu, alpha, n, span, i1) against a constant rate.

    lr is twice the difference, not below 0. Least squares is not the likelihood's top, so the test errs towards the
    constant rate. p_value is chi square's with 2 degrees of freedom, e^(-lr / 2). A key without events of its own has 0
    and 1."""
    known = events.where(F.col(key).isNotNull() & F.col(t).isNotNull())
    times = known.groupBy(key, t).agg(F.sum(F.lit(1) if own is None else own).alias("c"), F.sum(mark).alias("m"))
    logs = []
    for r in rates.select("beta").distinct().orderBy("beta").collect():
        own_rates = rates.where(F.col("beta") == r["beta"]).select(key, "mu", "alpha")
        k = kernel_sum(times.join(own_rates.select(key), key, "left_semi"), key, t, F.col("m"), r["beta"]).join(own_rates, key)
        logs.append(k.where("c > 0").groupBy(key).agg(F.sum(F.col("c") * F.log(F.col("mu") + F.col("alpha") * F.col("A"))).alias("logs")))
    if not logs:
        return rates.select(key, *[F.lit(v).alias(c) for c, v in (("ll", 0.0), ("ll_poisson", 0.0), ("lr", 0.0), ("p_value", 1.0))])
    return _against_constant(rates, key, reduce(DataFrame.unionByName, logs))


def _against_constant(rates: DataFrame, key: str, logs: DataFrame) -> DataFrame:
    """likelihood_ratio's columns, from the sums of the logarithms of the rates at the events (key, logs)."""
    both = rates.join(logs, key, "left")
    n, span = F.col("n"), F.col("span")
    ll = F.coalesce("logs", F.lit(0.0)) - F.when(n > 0, F.col("mu") * span + F.col("alpha") * F.col("i1")).otherwise(0.0)
    poisson = F.when(n > 0, n * F.log(n / span) - n).otherwise(0.0)
    lr = F.greatest(F.lit(0.0), 2 * (ll - poisson))
    return both.select(key, ll.alias("ll"), poisson.alias("ll_poisson"), lr.alias("lr"), F.exp(-lr / 2).alias("p_value"))


def local_rates(events: DataFrame, key: str, t: str, mark: Column, betas: Sequence[float], own: Column | None = None) -> DataFrame:
    """For each key its own best decay rate with mu, alpha, n, span, i1 and branching, and the test against a constant rate."""
    totals = kernel_moments(events, key, t, mark, betas, own).groupBy(key, "beta").agg(*[F.sum(c).alias(c) for c in SUMS])
    fits = least_squares(totals)
    best = fits.groupBy(key).agg(F.min_by(F.struct("beta", "mu", "alpha", "n", "span", "i1"), F.struct(-F.round("gain", 9), "beta")).alias("best"))
    rates = written(best.select(key, "best.*"), "local_rates")
    return rates.withColumn("branching", F.col("alpha") / F.col("beta")).join(likelihood_ratio(events, key, t, mark, rates, own), key)


def _site_sums(betas: Sequence[float], km: float, sigma: float, side: tuple[float, float], place: str, lows: np.ndarray, ends: np.ndarray):
    """For applyInPandas over a tile's block of time, events beside the kernels that come in from earlier blocks: for each of
    the tile's own sites the integrals of A and of A^2 over the block, and for each event there A at its time, where A
    is the sum by rate over earlier events within km of e^(-distance / sigma) times the kernel."""

    def run(key: tuple, e: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        tile, block = (int(key[0]), int(key[1])), int(key[2])
        low, end = lows[block], ends[block]
        e = e.sort_values("h", kind="stable")
        points = pd.concat([came[["lat", "lon"]], e[["lat", "lon"]]]).drop_duplicates(ignore_index=True)
        number = {p: i for i, p in enumerate(points.itertuples(index=False, name=None))}
        at = np.array([number[p] for p in zip(e["lat"], e["lon"])], int)
        carry = np.zeros((len(points), len(betas)))
        carry[[number[p] for p in zip(came["lat"], came["lon"])]] = np.stack(came["carry"].to_list()) if len(came) else np.zeros((0, len(betas)))
        lat, lon = points["lat"].to_numpy(float), points["lon"].to_numpy(float)
        own = np.flatnonzero((np.floor(lat / side[0]) == tile[0]) & (np.floor(lon / side[1]) == tile[1]))
        h, places = e["h"].to_numpy(float), e[place].to_numpy()
        sites, found = [], []
        for i in own:
            hav = np.sin(np.radians(lat - lat[i]) / 2) ** 2 + np.cos(np.radians(lat[i])) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - lon[i]) / 2) ** 2
            away = 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1.0, hav)))
            weight = np.where(away <= km, np.exp(-away / sigma), 0.0)
            near = np.flatnonzero(weight[at] > 0)
            mine = np.flatnonzero(at == i)
            first = np.flatnonzero(np.diff(h[near], prepend=-np.inf))
            times, marks = h[near][first], np.add.reduceat(weight[at[near]], first) if len(near) else np.zeros(0)
            into, sums = weight @ carry, np.zeros((2, len(betas)))
            before = np.zeros((len(times), len(betas)))
            gaps = np.diff(np.append(times, end))
            for b, beta in enumerate(betas):
                # in spans of time so short that no exponent leaves the range of a double
                cuts = np.append(np.flatnonzero(np.diff(np.floor((times - low) * beta / 300.0), prepend=-1.0)), len(times))
                held, since = into[b], low
                for x, y in zip(cuts, cuts[1:]):
                    grown = np.exp(beta * (times[x:y] - times[x]))
                    gained = marks[x:y] * grown
                    before[x:y, b] = (held * np.exp(-beta * (times[x] - since)) + np.cumsum(gained) - gained) / grown
                    held, since = before[y - 1, b] + marks[y - 1], times[y - 1]
                a, dt = np.append(into[b], before[:, b] + marks), np.append((times[0] if len(times) else end) - low, gaps)
                sums[:, b] = (a * (1 - np.exp(-beta * dt))).sum() / beta, (a * a * (1 - np.exp(-2 * beta * dt))).sum() / (2 * beta)
            sites.append((lat[i], lon[i], sums[0].tolist(), sums[1].tolist()))
            if len(mine):
                found += [(None, None, None, None, *x) for x in zip(places[mine].tolist(), before[np.searchsorted(times, h[mine])].tolist(), strict=True)]
        return pd.DataFrame([(*x, None, None) for x in sites] + found, columns=["lat", "lon", "i1", "i2", place, "a"], dtype=object)

    return run


def nearby_rates(events: DataFrame, places: DataFrame, place: str, t: str, km: float, sigma: float, betas: Sequence[float], block_rows: int = 100_000) -> DataFrame:
    """local_rates for each place and all events within km, weighted by e^(-distance / sigma), without a row for each event
    and place that it reaches.

    Places at one point share what they receive. Events are dealt by tiles a few times as wide as km, each with a margin, and
    by ranges of time; what a range leaves at a point is carried on to the next. A task walks one tile's range: it adds
    the integrals by point, which belong to all places there, and the kernel sum at each event, from which the sums and
    likelihoods of its place follow. places (place, lat, lon) has a row a place; bounds of the ranges come to the driver."""
    kind = events.schema[place].dataType.simpleString()
    side, margin = (4 * km / 111.0, 4 * km / (111.0 * 0.2)), (km / 111.0, km / (111.0 * 0.2))
    spots = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(place).alias(place), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    known = events.where(F.col(t).isNotNull()).select(F.col(place).alias(place), (F.col(t) / F.lit(3_600_000_000.0)).alias("h")).join(spots, place)
    counted = events.where(F.col(t).isNotNull() & F.col(place).isNotNull()).count()
    ranged = written(known.repartitionByRange(max(1, -(-counted // block_rows)), "h").withColumn("block", F.spark_partition_id()), "near_events")
    bounds = ranged.groupBy("block").agg(F.min("h").alias("low"), F.max("h").alias("high")).orderBy("block").toPandas()
    if not len(bounds):
        return local_rates(ranged.withColumn("t", F.col("h").cast("long")), place, "t", F.lit(1.0), betas)
    order = {int(b): i for i, b in enumerate(bounds["block"])}
    lows = bounds["low"].to_numpy(float)
    ends = np.append(lows[1:], bounds["high"].iloc[-1])
    span = float(ends[-1] - lows[0])
    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ends_at = F.array(*[F.lit(float(x)) for x in ends])
    cells = [F.array_distinct(F.array(*[F.floor((F.col(c) + i * m) / s).cast("int") for i in (-1, 0, 1)])) for c, m, s in zip(("lat", "lon"), margin, side)]

    def tiled(df: DataFrame) -> DataFrame:
        return df.withColumn("tile_lat", F.explode(cells[0])).withColumn("tile_lon", F.explode(cells[1]))

    rows = ranged.withColumn("block", numbers[F.col("block")])
    left = rows.groupBy("lat", "lon", "block").agg(F.array(*[F.sum(F.exp(-float(b) * (ends_at[F.col("block")] - F.col("h")))) for b in betas]).alias("left"))
    rates, steps = np.array(betas, float), ends - lows

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        """What of earlier blocks' events is left at each point at each block's start."""
        out, now = [], {}
        blocks = dict(list(frame.groupby("block")))
        for block in range(len(lows)):
            if now:
                points = list(now)
                out.append(pd.DataFrame({"tile_lat": frame["tile_lat"].iloc[0], "tile_lon": frame["tile_lon"].iloc[0], "block": block, "lat": [p[0] for p in points], "lon": [p[1] for p in points], "carry": list(now.values())}))
            now = {p: c * np.exp(-rates * steps[block]) for p, c in now.items()}
            if block in blocks:
                part = blocks[block]
                for p, x in zip(zip(part["lat"], part["lon"]), part["left"]):
                    now[p] = now.get(p, 0.0) + np.asarray(x)
        return pd.concat(out) if out else pd.DataFrame(columns=["tile_lat", "tile_lon", "block", "lat", "lon", "carry"], dtype=object)

    came = tiled(left).groupBy("tile_lat", "tile_lon").applyInPandas(carried, "tile_lat int, tile_lon int, block int, lat double, lon double, carry array<double>")
    by = ["tile_lat", "tile_lon", "block"]
    tasks = max(len(lows), events.sparkSession.sparkContext.defaultParallelism)
    here, there = (df.repartition(tasks, *by).groupBy(*by) for df in (tiled(rows), came))
    walk = _site_sums(betas, km, sigma, side, place, lows, ends)
    walked = written(here.cogroup(there).applyInPandas(walk, f"lat double, lon double, i1 array<double>, i2 array<double>, {place} {kind}, a array<double>"), "near_sums")

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(b)).alias("beta")) for i, b in enumerate(betas)])).alias("rate")
    seen = walked.where(F.col("a").isNotNull())
    own = seen.groupBy(place).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(F.col("a")[i]) for i in range(len(betas))]).alias("y"))
    sites = walked.where(F.col("i1").isNotNull()).groupBy("lat", "lon").agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(len(betas))]).alias(c) for c in ("i1", "i2")])
    sums = spots.join(sites, ["lat", "lon"]).join(own, place).select("*", each)
    totals = sums.select(place, F.col("rate.beta").alias("beta"), F.col("rate.i").alias("i"), "n", F.lit(span).alias("span"), *[F.col(c)[F.col("rate.i")].alias(c) for c in ("i1", "i2", "y")])
    best = least_squares(totals).groupBy(place).agg(F.min_by(F.struct("beta", "mu", "alpha", "n", "span", "i1", "i"), F.struct(-F.round("gain", 9), "beta")).alias("best"))
    rates_of = written(best.select(place, "best.*"), "local_rates")
    logs = seen.join(rates_of.select(place, "mu", "alpha", "i"), place).groupBy(place).agg(F.sum(F.log(F.col("mu") + F.col("alpha") * F.col("a")[F.col("i")])).alias("logs"))
    rates_of = rates_of.drop("i")
    return rates_of.withColumn("branching", F.col("alpha") / F.col("beta")).join(_against_constant(rates_of, place, logs), place)
