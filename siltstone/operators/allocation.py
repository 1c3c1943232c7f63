"""Sharing limited resources: proportional allocation, tiers, tail risk and what-if grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allocate(sites: DataFrame, key: str, weight: str, budget: int, cap: int) -> DataFrame:
    """sites with units: the floor of each share, then one more by largest remainder, no more than cap each.

    Capped units are not handed on. The windows run over sites, a dimension."""
    total = F.sum(weight).over(W.partitionBy())
    share = sites.withColumn("share", F.lit(float(budget)) * F.col(weight) / total).withColumn("base", F.least(F.floor("share"), F.lit(cap)))
    left = F.lit(budget) - F.sum("base").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc(F.round(F.col("share") - F.floor("share"), 9)), key))
    out = share.withColumn("left", left).withColumn("place", order)
    return out.withColumn("units", (F.col("base") + ((F.col("place") <= F.col("left")) & (F.col("base") < cap)).cast("int")).cast("int")).drop("share", "base", "left", "place")


def tiers(sites: DataFrame, order: Sequence[Column], shares: Mapping[str, float], rest: str) -> DataFrame:
    """sites with tier: the first rows in order by shares of their number, rounded up and 1 at least, then the rest."""
    ranked = sites.withColumn("place", F.row_number().over(W.orderBy(*order))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy()))
    tier, until = None, F.lit(0)
    for name, share in shares.items():
        until = until + F.greatest(F.lit(1), F.ceil(F.col("all") * share))
        tier = F.when(F.col("place") <= until, name) if tier is None else tier.when(F.col("place") <= until, name)
    return ranked.withColumn("tier", tier.otherwise(rest)).drop("place", "all")


def tail_risk(rows: DataFrame, by: Sequence[str], x: str, alphas: Sequence[float]) -> DataFrame:
    """by, alpha, var, cvar: the value at position min(floor(alpha n), n - 1) and the mean from there on."""
    part = W.partitionBy(*by)
    ranked = rows.withColumn("i", F.row_number().over(part.orderBy(x)) - 1).withColumn("n", F.count(F.lit(1)).over(part))
    cut = ranked.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    tail = cut.where(F.col("i") >= F.least(F.floor(F.col("alpha") * F.col("n") + 1e-9), F.col("n") - 1))
    return tail.groupBy(*by, "alpha").agg(F.min(x).alias("var"), F.avg(x).alias("cvar"))


def what_if(sites: DataFrame, key: str, scenarios: Mapping[str, Mapping[str, float]], effect: Column, names: Sequence[str]) -> DataFrame:
    """key, scenario, effect, gain and whether it is the site's best: each site under each scenario's extra units.

    `effect` is an expression over site columns and the scenario's columns add_<name>; the scenario named base
    has none. Of equal gains the first scenario is best."""
    spark: SparkSession = sites.sparkSession
    rows = [(i, s, *[float(extra.get(n, 0.0)) for n in names]) for i, (s, extra) in enumerate(scenarios.items())]
    table = spark.createDataFrame(rows, "i int, scenario string, " + ", ".join(f"add_{n} double" for n in names))
    out = sites.crossJoin(F.broadcast(table)).withColumn("effect", effect)
    base = F.max(F.when(F.col("scenario") == "base", F.col("effect"))).over(W.partitionBy(key))
    out = out.withColumn("gain", F.round((F.col("effect") - base) / F.greatest(1 - base, F.lit(1e-9)), 9))
    return out.withColumn("best", (F.row_number().over(W.partitionBy(key).orderBy(F.desc("gain"), "i")) == 1) & (F.col("scenario") != "base"))


def knapsack(sites: DataFrame, key: str, score: str, needs: Mapping[str, str], budgets: Mapping[str, float]) -> DataFrame:
    """key and fraction: sites in order of score take what they need, as far as every budget goes.

    Greedy by prefix sums: the site at which a budget ends gets the fraction that still fits, later ones nothing.
    A heuristic: it is optimal for one budget alone."""
    order = W.orderBy(F.desc(score), key).rowsBetween(W.unboundedPreceding, 0)
    fraction = F.lit(1.0)
    for name, column in needs.items():
        before = F.sum(column).over(order) - F.col(column)
        fraction = F.least(fraction, F.when(F.col(column) > 0, F.greatest(F.lit(0.0), (F.lit(float(budgets[name])) - before) / F.col(column))).otherwise(1.0))
    return sites.withColumn("fraction", F.round(F.least(F.lit(1.0), fraction), 9))
