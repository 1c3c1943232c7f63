"""Shares under several budgets by dual prices; scenarios, chance constraints, robustness and fronts of plans."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.relational import value_ranks
from siltstone.sources.scratch import written


def fractional_knapsack(sites: DataFrame, score: str, needs: Mapping[str, str], budgets: Mapping[str, float], *, gap: float = 5e-3, most_passes: int = 150) -> tuple[DataFrame, dict]:
    """sites with fraction, and a report of prices, uses, value, bound and gap.

    Maximises the sum of score * fraction, fractions from 0 to 1, while each need's sum stays in its budget. Given prices of
    the resources every site decides for itself, so a pass over the sites is one aggregate of a few sums; prices come
    from Newton steps on the dual, smoothed so that a site near its break-even takes a part, with less smoothing each
    time. Any prices give a bound and any scaled fractions a value, so the gap between them is proven; passes end when
    it is below `gap`, or when smoothing is over, as with a handful of sites, where the gap may stay larger. Null scores and needs count as 0; negative scores get nothing.
    """
    spark = sites.sparkSession
    names = list(needs)
    value = F.greatest(F.lit(0.0), F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    columns = [F.greatest(F.lit(0.0), F.coalesce(F.col(needs[k]).cast("double"), F.lit(0.0))) for k in names]
    data = written(sites.select(value.alias("v"), *[c.alias(f"a{i}") for i, c in enumerate(columns)]), "sites")
    limit = np.array([float(budgets[k]) for k in names])
    totals = data.agg(F.avg("v").alias("v"), *[F.sum(f"a{i}") for i in range(len(names))]).first()
    uses = np.array([x or 0.0 for x in totals[1:]])
    if not totals["v"] or (uses <= limit).all():
        full = F.when(value > 0, 1.0).otherwise(0.0)
        worth = data.agg(F.sum("v")).first()[0] or 0.0
        return sites.withColumn("fraction", full), {"prices": dict.fromkeys(names, 0.0), "used": dict(zip(names, uses.tolist(), strict=True)), "value": worth, "bound": worth, "gap": 0.0}

    def fraction(prices: np.ndarray, eps: float, v: Column, a: list[Column]) -> tuple[Column, Column]:
        worth = v - sum((c * float(p) for c, p in zip(a, prices, strict=True)), F.lit(0.0))
        return worth, F.when(v > 0, 1 / (1 + F.exp(-worth / eps))).otherwise(0.0)

    def measure(prices: np.ndarray, eps: float) -> dict:
        a = [F.col(f"a{i}") for i in range(len(names))]
        worth, x = fraction(prices, eps, F.col("v"), a)
        rows = data.select("v", *a, worth.alias("worth"), x.alias("x"))
        soft = F.greatest(F.lit(0.0), F.col("worth")) + eps * F.log1p(F.exp(-F.abs(F.col("worth")) / eps))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        got = rows.agg(
            F.sum(soft),
            F.sum(F.greatest(F.lit(0.0), F.col("worth"))),
            F.sum(F.col("v") * F.col("x")),
            *[F.sum(c * F.col("x")) for c in a],
            *[F.sum(a[i] * a[j] * F.col("x") * (1 - F.col("x"))) / eps for i, j in pairs],
        ).first()
        curve = np.zeros((len(names), len(names)))
        for (i, j), c in zip(pairs, got[3 + len(names) :], strict=True):
            curve[i, j] = curve[j, i] = c
        used = np.array(got[3 : 3 + len(names)])
        scale = min(1.0, float(np.min(np.where(used > 0, limit / np.where(used > 0, used, 1.0), 1.0))))
        return {"prices": prices, "eps": eps, "soft": got[0] + prices @ limit, "bound": got[1] + prices @ limit, "used": used * scale, "value": got[2] * scale, "scale": scale, "slope": limit - used, "curve": curve}

    usual = float(totals["v"])
    eps = usual
    at = best = measure(np.where(uses > limit, usual * data.count() / np.maximum(uses, 1e-12), 0.0) / len(names), eps)
    bound = at["bound"]
    for _ in range(most_passes):
        if bound - best["value"] <= gap * abs(bound) or eps < 1e-5 * usual:
            break
        g, h, p = at["slope"], at["curve"], at["prices"]
        move = ~((p <= 0) & (g >= 0))
        step = np.zeros(len(names))
        if move.any():
            part = h[np.ix_(move, move)]
            step[move] = -np.linalg.pinv(part + (1e-9 * np.trace(part) + 1e-12) * np.eye(move.sum())) @ g[move]
            step *= min(1.0, max(p.max(), usual) / max(np.abs(step).max(), 1e-300))
        found = None
        if move.any() and abs(g @ step) >= 0.02 * gap * abs(bound):
            for size in (1.0, 0.25, 0.0625, 0.015625):
                found = measure(np.maximum(0.0, p + size * step), eps)
                if found["soft"] <= at["soft"] + 1e-4 * size * (g @ step):
                    break
                found = None
        if found is None:  # nothing more to gain with so much smoothing
            eps /= 4
            found = measure(p, eps)
        at = found
        bound = min(bound, at["bound"])
        best = max(best, at, key=lambda m: m["value"])
    _, x = fraction(best["prices"], best["eps"], value, columns)
    report = {
        "prices": dict(zip(names, best["prices"].tolist(), strict=True)),
        "used": dict(zip(names, best["used"].tolist(), strict=True)),
        "value": float(best["value"]),
        "bound": float(bound),
        "gap": float((bound - best["value"]) / abs(bound)),
    }
    return sites.withColumn("fraction", F.lit(best["scale"]) * x), report


def chance_table(outcomes: DataFrame, keys: list[str], met: Column, tail: Column, alpha: float = 0.9) -> DataFrame:
    """By plan and site: scenarios, the share in which the constraint is met, and the mean of `tail` over the worst scenarios,
    from the value at place floor(alpha n) on."""
    own = W.partitionBy(*keys)
    rows = outcomes.withColumns({"is_met": met.cast("double"), "tail": tail})
    placed = rows.withColumn("place", F.row_number().over(own.orderBy("tail")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    worst = F.col("place") >= F.least(F.floor(F.lit(alpha) * F.col("n") + 1e-9), F.col("n") - 1)
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("scenarios"), F.avg("is_met").alias("satisfied"), F.avg(F.when(worst, F.col("tail"))).alias("cvar"))


def pareto_front(plans: DataFrame, cost: str, benefit: str) -> DataFrame:
    """The plans that no other plan beats: none costs as little or less and gains as much or more, one of them strictly.

    Costs are dealt by ranges; within a range and, through the ranges' best gains, over lower ranges, a plan must gain more
    than everything cheaper and as much as everything as cheap. Equal plans stay together. Plans with a null are left out."""
    rows = plans.where(F.col(cost).isNotNull() & F.col(benefit).isNotNull())
    parts = written(value_ranks(rows.select(F.col(cost).alias("c")), "c").select("c", "part"), "costs")
    at = rows.groupBy(F.col(cost).alias("c")).agg(F.max(benefit).alias("best")).join(parts, "c")
    by_part = at.groupBy("part").agg(F.max("best").alias("best"))
    lower = by_part.select("part", F.max("best").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("lower"))
    cheaper = F.max("best").over(W.partitionBy("part").orderBy("c").rowsBetween(W.unboundedPreceding, -1))
    front = at.withColumn("cheaper", cheaper).join(F.broadcast(lower), "part")
    before = F.greatest("cheaper", "lower")
    kept = front.where(before.isNull() | (F.col("best") > before)).select(F.col("c").alias("front_cost"), F.col("best").alias("front_best"))
    return rows.join(kept, (F.col(cost) == F.col("front_cost")) & (F.col(benefit) == F.col("front_best"))).drop("front_cost", "front_best")
