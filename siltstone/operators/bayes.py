"""Posterior updates of log durations by stratum, calibration, classification metrics and drift measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.expressions import clip
from siltstone.operators.relational import exact_quantiles, fallback_lookup, quantile_bins, value_ranks


def forgetting(age_days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-math.log(2) / half_life * F.greatest(age_days, F.lit(0)))


def weighted_moments(rows: DataFrame, keys: Sequence[str], x: Column, w: Column, floor: float = 1e-6) -> DataFrame:
    """keys, n, n_eff (Kish), mean and variance, both weighted by w; the variance is the population's, floored."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    mean = F.col("swx") / F.col("sw")
    return sums.select(*keys, "n", (F.col("sw") * F.col("sw") / F.col("sww")).alias("n_eff"), mean.alias("mean"), F.greatest(F.lit(floor), F.col("swxx") / F.col("sw") - mean * mean).alias("variance"))


def trimmed_moments(rows: DataFrame, x: str, w: str, trim: float = 0.05, floor: float = 1e-6) -> DataFrame:
    """One row: n, mean and variance, both weighted by w, of the rows that are left when the share `trim`, and one row at
    least, of each end is cut off by x.

    Rows of equal x are one cell, of whose weight the part of its rows that stay counts, so that ties are cut alike whatever
    their order. With fewer than 4 rows, or 2 that stay, nothing is cut. Rows without x or w go; without rows mean and
    variance are null."""
    known = rows.where(F.col(x).isNotNull() & F.col(w).isNotNull() & ~F.isnan(x))
    cells = known.groupBy(x).agg(F.sum(w).alias("w")).join(value_ranks(known, x).drop("part"), x)
    total = known.agg(F.count(F.lit(1)).alias("total"))
    cut = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(trim)))
    cut = F.when((F.col("total") < 4) | (F.col("total") - 2 * cut < 2), 0).otherwise(cut)
    kept = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.col("total") - F.col("cut")) - F.greatest(F.col("below"), F.col("cut")))
    left = cells.crossJoin(F.broadcast(total)).withColumn("cut", cut).withColumn("kept", kept).withColumn("share", F.col("w") * F.col("kept") / F.col("n"))
    sums = left.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("n"), F.sum("share").alias("sw"), F.sum(F.col("share") * F.col(x)).alias("swx"), F.sum(F.col("share") * F.col(x) * F.col(x)).alias("swxx"))
    mean = F.col("swx") / F.col("sw")
    spread = F.col("swxx") / F.col("sw") - mean * mean
    return sums.where("n = 0 or sw <> 0").select("n", mean.alias("mean"), F.when(spread.isNotNull(), F.greatest(F.lit(floor), spread)).alias("variance"))


def normal_posterior(prior: DataFrame, prior_keys: Sequence[str], feedback: DataFrame, x: Column, w: Column, strata: Sequence[str], least: int = 3) -> DataFrame:
    """For each stratum of the feedback: its prior from the first supported level, and the normal posterior.

    Levels are the strata, then their first key, then all of the prior rows. With n_eff below 1 the prior stays.
    """
    one = F.lit(1.0)
    levels = [(name, weighted_moments(prior, keys, x, one), keys) for name, keys in (("stratum", list(prior_keys)), ("cause", list(prior_keys)[:1]), ("global", []))]
    new = weighted_moments(feedback, strata, x, w).withColumnsRenamed({"n": "n_feedback", "mean": "feedback_mean", "variance": "feedback_variance"})
    levels = [(name, stats.withColumnsRenamed({"mean": "prior_mean", "variance": "prior_variance"}), keys) for name, stats, keys in levels]
    out = fallback_lookup(levels, new, ["prior_mean", "prior_variance"], {"prior_mean": 0.0, "prior_variance": 1.0}, least=least)
    precision = 1 / F.col("prior_variance") + F.col("n_eff") / F.col("prior_variance")
    mean = (F.col("prior_mean") / F.col("prior_variance") + F.col("n_eff") * F.col("feedback_mean") / F.col("prior_variance")) / precision
    informed = F.col("n_eff") >= 1
    out = out.withColumn("posterior_mean", F.when(informed, mean).otherwise(F.col("prior_mean"))).withColumn("posterior_variance", F.when(informed, 1 / precision).otherwise(F.col("prior_variance")))
    return out.withColumn("prior_influence", clip(F.col("posterior_variance") / F.col("prior_variance"), 0.0, 1.0))


def prequential(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, prior_mean: float, prior_variance: float) -> DataFrame:
    """rows with the predictive mean and variance from the rows of their stratum before them alone."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    n, total = F.count(F.lit(1)).over(before), F.coalesce(F.sum(x).over(before), F.lit(0.0))
    out = rows.withColumn("n_before", n).withColumn("predictive_mean", (F.lit(prior_mean) + total) / (1 + n))
    out = out.withColumn("predictive_variance", prior_variance * (1 + 1 / (1 + F.col("n_before"))))
    half = 1.959964 * F.sqrt("predictive_variance")
    return out.withColumn("covered", F.abs(F.col(x) - F.col("predictive_mean")) <= half)


def sharpness_curve(rows: DataFrame, width: str, covered: str, bins: int = 20) -> DataFrame:
    """bin, n, interval_width, empirical_coverage: the share of covered rows by bins of equal numbers of rows, from narrow
    to wide intervals. There are at most `bins`, one for five rows, and three at least; equal edges are one. Rows without width or
    verdict go; an empty table gives no rows."""
    known = rows.where(F.col(width).isNotNull() & F.col(covered).isNotNull())
    counts = known.groupBy(width).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(covered).cast("int")).alias("hits"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    edges = exact_quantiles(known, width, min(bins, max(3, total // 5)))
    numbered = counts.withColumn("bin", quantile_bins(F.col(width), F.array(*[F.lit(e) for e in edges])) if edges else F.lit(1))
    return numbered.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col(width) * F.col("n")) / F.sum("n")).alias("interval_width"), (F.sum("hits") / F.sum("n")).alias("empirical_coverage"))


def forecast_quality(rows: DataFrame, x: str, mean: str, predictive_sd: str, posterior_sd: str, crps: Column, level_z: float = 1.959964) -> DataFrame:
    """metric, value: coverage of 95 % intervals with and without the spread of observations, their widths, CRPS, mean spreads,
    coverage per width and distance from 95 %."""
    p, q, miss = F.col(predictive_sd), F.col(posterior_sd), F.abs(F.col(x) - F.col(mean))
    known = rows.where(miss.isNotNull() & p.isNotNull()).withColumn("width", 2 * level_z * p)
    a = known.agg(
        F.avg((miss <= level_z * p).cast("double")).alias("coverage"), F.avg((miss <= level_z * q).cast("double")).alias("coverage_param"), F.avg("width").alias("width"), F.avg(crps).alias("crps"),
        F.avg(p).alias("predictive"), F.avg(q).alias("posterior"), F.avg(F.sqrt(F.greatest(p * p - q * q, F.lit(0.0)))).alias("observation"),
    )
    median = exact_quantiles(known, "width", 2)
    values = {
        "coverage_95": F.col("coverage"), "coverage_95_param_only": F.col("coverage_param"), "coverage_delta": F.col("coverage") - F.col("coverage_param"), "mean_sharpness": F.col("width"), "median_sharpness": F.lit(median[1] if median else None).cast("double"),
        "crps": F.col("crps"), "mean_predictive_sd": F.col("predictive"), "mean_posterior_sd": F.col("posterior"), "mean_observation_sd": F.col("observation"), "sharpness_efficiency": F.when(F.col("width") > 0, F.col("coverage") / F.col("width")), "coverage_penalty": F.abs(F.col("coverage") - 0.95),
    }
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])))


def calibration_bins(rows: DataFrame, p: str, y: str, bins: int = 10, closed_last: bool = True) -> DataFrame:
    """bin, n, mean_p and rate for equal bins of p; p = 1 is in the last bin, or left out."""
    b = F.floor(F.col(p) * bins).cast("int")
    rows = rows.withColumn("bin", F.least(b, F.lit(bins - 1)) if closed_last else b).where(F.col("bin") < bins)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def beta_posterior(bins: DataFrame, a: float = 1.0, b: float = 1.0, level: float = 0.95) -> DataFrame:
    """bins with the Beta posterior's mean and equal-tailed interval."""

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
        tail = (1 - level) / 2
        return pd.DataFrame({"low": [beta_quantile(tail, x, y) for x, y in zip(alpha, beta, strict=True)], "high": [beta_quantile(1 - tail, x, y) for x, y in zip(alpha, beta, strict=True)]})

    hits = F.round(F.col("n") * F.col("rate"))
    alpha, beta = hits + a, F.col("n") - hits + b
    out = bins.withColumn("posterior_mean", alpha / (alpha + beta)).withColumn("interval", interval(alpha.cast("double"), beta.cast("double")))
    return out.withColumn("low", F.col("interval.low")).withColumn("high", F.col("interval.high")).drop("interval")


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def classification_metrics(rows: DataFrame, p: str, y: str, threshold: float = 0.5) -> DataFrame:
    """n, precision, recall, f1, brier and the area under the ROC curve by rank sums, ties averaged.

    Ranks come from counts by distinct score, so the ordered window runs over scores, not rows."""
    scores = rows.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    scores = scores.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    hit, chosen = F.col("pos").cast("double"), F.col("p") >= threshold
    sums = scores.agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum(F.col("rank") * hit).alias("ranks"),
        F.sum(F.when(chosen, F.col("pos"))).alias("tp"),
        F.sum(F.when(chosen, F.col("n"))).alias("chosen"),
        F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("pos")) * F.pow(F.col("p"), 2)).alias("squares"),
    )
    auc = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos")))
    return sums.select("n", (F.col("tp") / F.col("chosen")).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"), (2 * F.col("tp") / (F.col("chosen") + F.col("pos"))).alias("f1"), (F.col("squares") / F.col("n")).alias("brier"), auc.alias("roc_auc"))


def tune_thresholds(rows: DataFrame, group: str, p: str, y: str, beta: float = 2.0, steps: int = 50, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """group, threshold and F-beta score: the best of equally spaced thresholds, the lowest of equally good ones.

    Rows are counted by group and step first, so the grid multiplies counts, not rows."""
    width = (high - low) / (steps - 1)
    step = F.floor((F.col(p) - low) / width + 1e-9).cast("int")
    cells = rows.groupBy(group, F.greatest(F.lit(-1), F.least(F.lit(steps - 1), step)).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    grid = cells.select(group).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    totals = cells.groupBy(group).agg(F.sum("pos").alias("all_pos"))
    above = W.partitionBy(group).orderBy("step").rowsBetween(0, W.unboundedFollowing)
    curve = grid.join(cells, [group, "step"], "left").fillna(0, ["n", "pos"]).withColumns({"chosen": F.sum("n").over(above), "tp": F.sum("pos").over(above)}).join(totals, group)
    b2 = beta * beta
    score = (1 + b2) * F.col("tp") / (F.col("chosen") + b2 * F.col("all_pos"))
    best = curve.withColumn("score", F.coalesce(score, F.lit(0.0))).groupBy(group).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("step")).alias("step"))).alias("best"))
    return best.select(group, (F.lit(low) - F.col("best.step") * width).alias("threshold"), F.col("best.score").alias("score"))


def population_stability(base: DataFrame, new: DataFrame, x: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """psi between two samples over the base's quantile bins; new values outside them count in the total alone."""
    edges = base.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        inside = df.select(F.col(x).alias("x")).crossJoin(F.broadcast(edges))
        e = F.array_distinct("edges")
        binned = inside.withColumn("bin", F.when((F.col("x") >= e[0] - 1e-9) & (F.col("x") <= F.array_max(e) + 1e-9), F.greatest(F.lit(1), F.size(F.filter(e, lambda v: v < F.col("x"))))))
        counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        return counts.crossJoin(F.broadcast(df.agg(F.count(x).alias("total")))).where("bin is not null").select("bin", (F.col("n") / F.col("total")).alias(name))

    both = shares(base, "p").join(shares(new, "q"), "bin", "full")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(eps))
    return both.agg(F.count(F.lit(1)).alias("bins"), F.sum((q - p) * F.log(q / p)).alias("psi"))
