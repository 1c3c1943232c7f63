"""Censored durations: the survival table, Kaplan-Meier, restricted means, reliability and concordance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.expressions import clip
from siltstone.operators.relational import quantile_bins, running_sums, value_ranks
from siltstone.sources.scratch import written


def survival_table(df: DataFrame, *, start: str = "start_ts", end: str = "end_ts", duration: str = "duration", censored: str = "is_censored", trust: str = "trust") -> DataFrame:
    """df with T (days to the end, or to the end of the study), event and weight; rows without T or with a negative one go."""
    study = df.agg(F.max(F.greatest(start, end)).alias("study_end"))
    t = F.when(F.col(censored), F.datediff("study_end", start).cast("double")).otherwise(F.col(duration))
    rows = df.crossJoin(F.broadcast(study)).withColumn("T", t).withColumn("event", (~F.col(censored)).cast("int"))
    return rows.where(F.col("T") >= 0).withColumn("weight", clip(F.col(trust), 0.01, 1.0)).drop("study_end")


def kaplan_meier(rows: DataFrame, strata: Sequence[str]) -> DataFrame:
    """strata, T, d, at_risk, S at each distinct time: the weighted product-limit estimate.

    Rows are summed by time before any window, whose partitions then hold distinct times only.
    """
    times = rows.groupBy(*strata, "T").agg(F.sum(F.when(F.col("event") == 1, F.col("weight")).otherwise(0.0)).alias("d"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))
    part = W.partitionBy(*strata)
    later = part.orderBy("T").rowsBetween(0, W.unboundedFollowing)
    until = part.orderBy("T").rowsBetween(W.unboundedPreceding, 0)
    step = times.withColumn("at_risk", F.sum("w").over(later)).withColumn("left", 1 - F.col("d") / F.col("at_risk"))
    gone = F.max((F.col("left") <= 1e-12).cast("int")).over(until)
    s = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest("left", F.lit(1e-300)))).over(until)))
    return step.withColumn("S", s).drop("left")


def km_quantiles(km: DataFrame, strata: Sequence[str], quantiles: Sequence[float] = (0.5, 0.8, 0.95), least: int = 15) -> DataFrame:
    """For each stratum of enough rows the first time at which S has fallen to 1 - q, else the last time."""
    firsts = [F.coalesce(F.min(F.when(F.col("S") <= 1 - q + 1e-9, F.col("T"))), F.max("T")).alias(f"p{round(q * 100)}") for q in quantiles]
    out = km.groupBy(*strata).agg(F.sum("n").alias("n"), F.sum("events").alias("n_events"), F.sum("w").alias("weighted_n"), *firsts)
    return out.where(F.col("n") >= least)


def restricted_mean(km: DataFrame, strata: Sequence[str], horizons: Sequence[float]) -> DataFrame:
    """The area under S up to each horizon, by trapezoids between step points from S = 1 at 0."""
    order = W.partitionBy(*strata).orderBy("T")
    steps = km.withColumn("t0", F.coalesce(F.lag("T").over(order), F.lit(0.0))).withColumn("s0", F.coalesce(F.lag("S").over(order), F.lit(1.0))).withColumn("last", F.lead("T").over(order).isNull())

    def area(tau: float):
        end = F.least("T", F.lit(float(tau)))
        width = end - F.col("t0")
        s1 = F.when(F.col("T") <= tau, F.col("S")).otherwise(F.col("s0"))
        inside = F.when(width > 0, width * (F.col("s0") + s1) / 2).otherwise(0.0)
        beyond = F.when(F.col("last") & (F.col("T") < tau), (F.lit(float(tau)) - F.col("T")) * F.col("S")).otherwise(0.0)
        return F.sum(inside + beyond).alias(f"rmst_{tau:g}")

    return steps.groupBy(*strata).agg(*[area(tau) for tau in horizons])


def reliability_deciles(rows: DataFrame, risk: str, horizon: float, bins: int = 10) -> DataFrame:
    """bin, n, mean predicted and observed share of events by the horizon, for rows whose state there is known.

    Predictions are average ranks as shares; bins end at their quantiles, which are read off the rank table.
    """
    known = rows.where(((F.col("event") == 1) | (F.col("T") > horizon)) & F.col(risk).isNotNull())
    ranks = written(value_ranks(known, risk), "ranks")
    total = ranks.agg(F.sum("n")).first()[0] or 0
    p = (F.col("below") + (F.col("n") + 1) / 2) / float(max(total, 1))
    at = [i * (total - 1) / bins for i in range(bins + 1)]
    places = sorted({int(k) for x in at for k in (math.floor(x), math.ceil(x))})
    holds = [(F.col("below") <= k) & (F.col("below") + F.col("n") > k) for k in places]
    found = {k: r["p"] for r in (ranks.where(reduce(or_, holds)).select("below", "n", p.alias("p")).collect() if total else []) for k in places if r["below"] <= k < r["below"] + r["n"]}
    edges = sorted({found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at} if total else {0.0})
    scored = known.join(ranks.select(risk, p.alias("p")), risk)
    binned = scored.withColumn("bin", quantile_bins(F.col("p"), F.array(*[F.lit(e) for e in edges])))
    hit = ((F.col("event") == 1) & (F.col("T") <= horizon)).cast("double")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg(hit).alias("observed"))


def _won_within(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one range of risks: usable pairs won and tied, as half, by events over later times of the same range."""
    cells = cells.sort_values("risk", ignore_index=True)
    times, at = np.unique(cells["T"].to_numpy(float), return_inverse=True)
    n, events, risk = cells["n"].to_numpy(float), cells["events"].to_numpy(float), cells["risk"].to_numpy()
    smaller, won, step = np.zeros(len(times) + 1), 0.0, 512
    start = 0
    while start < len(cells):
        end = int(np.searchsorted(risk, risk[min(start + step, len(cells)) - 1], "right"))  # equal risks stay together
        part = slice(start, end)
        later = np.cumsum(smaller[::-1])[::-1]
        won += float((events[part] * later[at[part] + 1]).sum())
        for i in range(start, end, step):
            rows = slice(i, min(i + step, end))
            after = at[part][None, :] > at[rows][:, None]
            score = np.where(risk[part][None, :] < risk[rows][:, None], 1.0, np.where(risk[part][None, :] == risk[rows][:, None], 0.5, 0.0))
            won += float((events[rows][:, None] * n[part][None, :] * after * score).sum())
        smaller[:-1] += np.bincount(at[part], n[part], len(times))
        start = end
    return pd.DataFrame({"won": [won]})


def concordance(rows: DataFrame, risk: str) -> DataFrame:
    """usable, c_index: Harrell's index, the share of usable pairs in which the higher risk has the earlier event,
    ties of risk as half; pairs with equal times are not usable.

    Risks are dealt by ranges. Over lower ranges an event wins as many pairs as they have later times, which running
    sums by time count; within a range pairs are counted where it lies. No pair is listed. Null risks go.
    """
    # written before it is asked for nulls, so that a risk that is costly to tell is told once
    known = written(rows.select(F.col(risk).alias("risk"), "T", "event"), "risks").where("risk is not null")
    ranges = written(value_ranks(known, "risk").select("risk", "part"), "ranks")
    cells = written(known.join(ranges, "risk").groupBy("part", "risk", "T").agg(F.count(F.lit(1)).alias("n"), F.sum("event").cast("double").alias("events")), "cells")
    within = cells.groupBy("part").applyInPandas(_won_within, "won double").agg(F.coalesce(F.sum("won"), F.lit(0.0)).alias("within"))
    by_time = cells.groupBy("part", "T").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    grid = by_time.select("T").distinct().crossJoin(F.broadcast(by_time.select("part").distinct())).join(by_time, ["part", "T"], "left").na.fill(0)
    lower = grid.withColumn("lower", F.coalesce(F.sum("n").over(W.partitionBy("T").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    after = W.partitionBy("part").orderBy("T").rowsBetween(1, W.unboundedFollowing)
    across = lower.withColumn("later", F.coalesce(F.sum("lower").over(after), F.lit(0))).agg(F.coalesce(F.sum(F.col("events") * F.col("later")), F.lit(0.0)).alias("across"))
    totals = by_time.groupBy("T").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    from_here = running_sums(totals.withColumn("later", F.col("n")), "T", ["later"], descending=True).withColumn("later", F.col("later") - F.col("n"))
    usable = from_here.agg(F.coalesce(F.sum(F.col("events") * F.col("later")), F.lit(0.0)).alias("usable"))
    both = usable.crossJoin(F.broadcast(within)).crossJoin(F.broadcast(across))
    return both.select(F.col("usable").cast("long").alias("usable"), F.when(F.col("usable") > 0, (F.col("within") + F.col("across")) / F.col("usable")).alias("c_index"))
