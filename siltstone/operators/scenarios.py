"""Scenario sets, risk indices, prototype trust, rank changes and a proportional-hazards fit."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.relational import running_sums
from siltstone.sources.scratch import written


def hashed_normal(*keys: Column | str, seed: int = 42) -> Column:
    """A standard normal number that depends on the keys and the seed alone, so that every rerun draws it again."""
    u = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(salt), F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


def lognormal_scenarios(sites: DataFrame, key: str, mu: str, sigma: str, count: int, *, tail: int = 5, stretch: float = 1.5, seed: int = 42) -> DataFrame:
    """key, scenario, duration: lognormal draws for each site; the last `tail` scenarios use a stretched spread."""
    long = sites.select(key, mu, sigma).withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    spread = F.col(sigma) * F.when(F.col("scenario") >= count - tail, stretch).otherwise(1.0)
    return long.select(key, "scenario", F.exp(F.col(mu) + spread * hashed_normal(key, "scenario", seed=seed)).alias("duration"))


def reduce_scenarios(scenarios: DataFrame, key: str, keep: int, tail: int = 5) -> DataFrame:
    """scenario, weight: evenly spaced ones by total duration and the `tail` heaviest, with equal weights."""
    totals = scenarios.groupBy("scenario").agg(F.sum("duration").alias("total"))
    ranked = totals.withColumn("r", F.row_number().over(W.orderBy("total", "scenario")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - tail) / max(1, keep - tail)))
    chosen = ranked.where((F.col("r") >= F.col("n") - tail) | ((F.col("r") % step == 0) & (F.col("r") / step < keep - tail) & (F.col("r") < F.col("n") - tail)))
    return chosen.withColumn("weight", 1 / F.count(F.lit(1)).over(W.partitionBy())).select("scenario", "weight")


def budget_sensitivity(sites: DataFrame, key: str, weight: str, budgets: Sequence[int], cap: int, rate: float = 0.18) -> DataFrame:
    """budget, used, effect and the effect's gain on the next smaller budget: shadow prices by finite differences."""
    grid = sites.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    part = W.partitionBy("budget")
    share = F.col("budget") * F.col(weight) / F.sum(weight).over(part)
    based = grid.withColumn("share", share).withColumn("base", F.least(F.floor("share"), F.lit(cap)))
    placed = based.withColumn("left", F.col("budget") - F.sum("base").over(part)).withColumn("place", F.row_number().over(part.orderBy(F.desc(F.round(F.col("share") - F.floor("share"), 9)), key)))
    units = F.col("base") + ((F.col("place") <= F.col("left")) & (F.col("base") < cap)).cast("int")
    out = placed.withColumn("units", units).groupBy("budget").agg(F.sum("units").alias("used"), (F.sum(F.col(weight) * (1 - F.exp(-rate * F.col("units")))) / F.sum(weight)).alias("effect"))
    order = W.orderBy("budget")
    return out.withColumn("shadow_price", (F.col("effect") - F.lag("effect").over(order)) / (F.col("budget") - F.lag("budget").over(order)))


def risk_index(rows: DataFrame, by: str, p: Column, severity: Column, centrality: Column, floor: float = 0.05, z: float = 1.96) -> DataFrame:
    """by, index, low, high: mean of p * severity * (1 + centrality) with an interval of z deviations (of the population)."""
    v = p * F.greatest(severity, F.lit(floor)) * (1 + centrality)
    out = rows.withColumn("v", v).groupBy(by).agg(F.avg("v").alias("index"), F.stddev_pop("v").alias("sd"))
    return out.select(by, "index", F.greatest(F.lit(0.0), F.col("index") - z * F.col("sd")).alias("low"), (F.col("index") + z * F.col("sd")).alias("high"))


def updated_trust(prior: DataFrame, outcomes: DataFrame, keys: Sequence[str], rate: float = 0.2) -> DataFrame:
    """prior with trust moved towards the share of successes of its keys' outcomes (success 1, partial 0.5, failure 0)."""
    seen = outcomes.groupBy(*keys).agg(F.avg("success").alias("seen"), F.count(F.lit(1)).alias("n_outcomes"))
    out = prior.join(seen, list(keys), "left")
    moved = F.when(F.col("seen").isNotNull(), (1 - rate) * F.col("trust") + rate * F.col("seen")).otherwise(F.col("trust"))
    return out.withColumn("trust", moved).withColumn("n_outcomes", F.coalesce("n_outcomes", F.lit(0))).drop("seen")


def rank_change(dim: DataFrame, key: str, before: str, after: str) -> DataFrame:
    a, b = (F.row_number().over(W.orderBy(F.desc(c), key)) for c in (before, after))
    return dim.select(key, a.alias("rank_before"), b.alias("rank_after")).withColumn("moved", F.abs(F.col("rank_before") - F.col("rank_after")))


def renormalised(parts: Mapping[str, float]) -> Column:
    """A weighted mean of columns without those that are null; null if all are."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    return F.when(total > 0, value / total)


def cox_fit(rows: DataFrame, numeric: Sequence[str], rounds: int = 8) -> dict[str, float]:
    """Coefficients of a weighted proportional-hazards model (Breslow ties) of columns T, event, weight.

    Each round sums the risk sets of distinct times from the latest time down, by ranges of time, after summing rows by
    time; only a gradient and a matrix of the number of columns squared reach the driver."""
    beta = np.zeros(len(numeric))
    pairs = [(i, j) for i in range(len(numeric)) for j in range(i, len(numeric))]
    for _ in range(rounds):
        score = sum((F.col(c) * float(b) for c, b in zip(numeric, beta, strict=True)), F.lit(0.0))
        r = rows.withColumn("r", F.col("weight") * F.exp(score))
        d = F.when(F.col("event") == 1, F.col("weight")).otherwise(0.0)
        sums = [F.sum("r").alias("s")] + [F.sum(F.col("r") * F.col(c)).alias(f"s{i}") for i, c in enumerate(numeric)] + [F.sum(F.col("r") * F.col(numeric[i]) * F.col(numeric[j])).alias(f"s{i}_{j}") for i, j in pairs]
        times = r.groupBy("T").agg(F.sum(d).alias("d"), *[F.sum(d * F.col(c)).alias(f"d{i}") for i, c in enumerate(numeric)], *sums)
        names = ["s", *[f"s{i}" for i in range(len(numeric))], *[f"s{i}_{j}" for i, j in pairs]]
        risk = running_sums(written(times, "times"), "T", names, descending=True).where("d > 0")
        got = risk.agg(*[F.sum(F.col(f"d{i}") - F.col("d") * F.col(f"s{i}") / F.col("s")).alias(f"g{i}") for i in range(len(numeric))], *[F.sum(F.col("d") * (F.col(f"s{i}_{j}") / F.col("s") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("s") * F.col("s")))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        gradient = np.array([got[f"g{i}"] for i in range(len(numeric))])
        information = np.zeros((len(numeric), len(numeric)))
        for i, j in pairs:
            information[i, j] = information[j, i] = got[f"h{i}_{j}"]
        step = np.linalg.solve(information + 1e-9 * np.eye(len(numeric)), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return dict(zip(numeric, beta.tolist(), strict=True))
