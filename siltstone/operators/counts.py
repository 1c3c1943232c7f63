"""Counts with a part of their own for zeros: whether there is any, and how many if so."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.expressions import log_gamma
from siltstone.sources.scratch import written

#: Dispersions that are tried first; 0 is a Poisson distribution.
ALPHAS = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


def _linear(coefficients: np.ndarray, features: Sequence[str]) -> Column:
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b) for c, b in zip(features, coefficients[1:], strict=True)), F.lit(float(coefficients[0])))


@dataclass
class Hurdle:
    """Coefficients, the intercept first: gamma of the odds of any, beta of the log rate; alpha is the dispersion and ll and
    ll_poisson the log-likelihoods of the positive counts with it and without, the latter at beta_poisson."""

    features: list[str]
    offset: str | None
    gamma: np.ndarray
    beta: np.ndarray
    alpha: float
    ll: float
    ll_poisson: float
    beta_poisson: np.ndarray

    def without_dispersion(self) -> Hurdle:
        """The Poisson model that was fitted beside this one."""
        return replace(self, beta=self.beta_poisson, alpha=0.0, ll=self.ll_poisson)

    def any(self) -> Column:
        return 1 / (1 + F.exp(-_linear(self.gamma, self.features)))

    def positive_mean(self) -> Column:
        """The mean count where there is any; 1 where the rate is next to nothing."""
        rate = F.exp(_linear(self.beta, self.features) + (F.coalesce(F.col(self.offset), F.lit(0.0)) if self.offset else F.lit(0.0)))
        none = F.log1p(self.alpha * rate) / self.alpha if self.alpha else rate
        return F.when(rate > 1e-9, rate / -F.expm1(-none)).otherwise(1.0)

    def expected(self) -> Column:
        return self.any() * self.positive_mean()


def truncated_parts(y: np.ndarray, eta: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positive counts at log rates: the log-likelihood of a zero-truncated negative binomial, its slope in the log rate,
    and the expected curvature."""
    mu = np.exp(np.clip(eta, -30, 30))
    grown = np.log1p(alpha * mu)
    none = grown / alpha if alpha else mu
    some = -np.expm1(-none)
    ll = y * eta - none - y * grown - log_gamma(y + 1, np.log) - np.log(some)
    if alpha:
        ll = ll + log_gamma(y + 1 / alpha, np.log) - log_gamma(np.array(1 / alpha), np.log) + y * np.log(alpha)
    shrink, mean = 1 / (1 + alpha * mu), mu / some
    variance = (mu + (1 + alpha) * mu * mu) / some - mean * mean
    return ll, shrink * (y - mean), np.maximum(shrink * shrink * variance, 1e-12)


def logistic_parts(y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    return np.where(y > 0, np.log(p), np.log1p(-p)), (y > 0) - p, np.maximum(p * (1 - p), 1e-12)


def _climb(data: DataFrame, parts: Sequence[Callable], start: np.ndarray, use_offset: bool, passes: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and log-likelihoods of several models side by side by Newton steps, halved where they lose.

    A pass is one aggregate of gradients and matrices of the number of columns squared; a task sends one row a sum."""
    models, k = start.shape
    size = 1 + k + k * k

    def sums(trial: np.ndarray, which: list[int]) -> dict[int, np.ndarray]:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((len(which), size))
            for batch in batches:
                table = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)])
                y, offset, x = table[:, 0], table[:, 1], table[:, 2:]
                x = np.column_stack([np.ones(len(y)), x])
                for at, m in enumerate(which):
                    ll, slope, bend = parts[m](y, x @ trial[m] + (offset if use_offset else 0.0))
                    total[at] += np.concatenate([[ll.sum()], x.T @ slope, (x.T @ (x * bend[:, None])).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["slot", "value"])

        out = np.zeros(len(which) * size)
        for slot, value in data.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value")).collect():
            out[slot] = value
        return dict(zip(which, out.reshape(len(which), size), strict=True))

    at, step, scale, top = start.copy(), np.zeros_like(start), np.ones(models), np.full(models, -np.inf)
    going = list(range(models))
    for _ in range(passes):
        trial = at + scale[:, None] * step
        for m, found in sums(trial, going).items():
            if found[0] >= top[m] - 1e-9:
                at[m], top[m], scale[m] = trial[m], found[0], 1.0
                step[m] = np.linalg.solve(found[1 + k :].reshape(k, k) + 1e-9 * np.eye(k), found[1 : 1 + k])
            else:
                scale[m] /= 2
        going = [m for m in going if np.abs(scale[m] * step[m]).max() > 1e-8 and scale[m] > 1e-6]
        if not going:
            break
    return at, top


def fit_hurdle(rows: DataFrame, label: str, features: Sequence[str], *, offset: str | None = None, least: int = 10, refinements: int = 3) -> Hurdle:
    """A logistic model of label > 0 and a zero-truncated negative binomial of the positive labels, with an offset to the log
    rate (but not to the odds). The dispersion is found by profile likelihood: a grid, then finer ones around the best.

    Rows without a label go and missing features count as 0. With fewer than `least` rows of a class the odds are the same
    for all rows; with fewer positive rows than that, so is the rate, which is then their mean."""
    features = list(features)
    exposure = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset else F.lit(0.0)
    data = written(rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), exposure.alias("offset"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]), "counts")
    some = data.where("y > 0")
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("some"), F.avg(F.when(F.col("y") > 0, F.col("y"))).alias("mean"), F.avg(F.when(F.col("y") > 0, F.col("offset"))).alias("offset")).first()
    k = len(features) + 1
    gamma, beta = np.zeros(k), np.zeros(k)
    gamma[0] = np.log((stats["some"] + 0.5) / (stats["n"] - stats["some"] + 0.5))
    if min(stats["some"], stats["n"] - stats["some"]) >= least:
        gamma = _climb(data, [logistic_parts], gamma[None, :], False)[0][0]
    if stats["some"] < least:
        beta[0] = np.log(stats["mean"] or 1.0) - (stats["offset"] or 0.0)
        return Hurdle(features, offset, gamma, beta, 0.0, 0.0, 0.0, beta)

    def profile(alphas: Sequence[float], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = lambda a: lambda y, eta: truncated_parts(y, eta, a)
        return _climb(some, [model(float(a)) for a in alphas], np.repeat(start[None, :], len(alphas), 0), True)

    beta[0] = np.log(max(stats["mean"] - 0.5, 0.1)) - stats["offset"]
    alphas = np.array(ALPHAS)
    at, ll = profile(alphas, beta)
    poisson = float(ll[0]), at[0]
    for _ in range(refinements):
        i = int(np.argmax(ll))
        best = alphas[i], at[i], ll[i]
        low, high = alphas[max(0, i - 1)], alphas[min(len(alphas) - 1, i + 1)]
        alphas = np.linspace(low, high, 7)
        at, ll = profile(alphas, best[1])
    i = int(np.argmax(ll))
    found = (alphas[i], at[i], ll[i]) if ll[i] >= best[2] else best
    return Hurdle(features, offset, gamma, found[1], float(found[0]), float(found[2]), *poisson)


def forecast_scores(rows: DataFrame, keys: Sequence[str], p: str, expected: str, y: str) -> DataFrame:
    """By keys: n, Brier score, log loss and area under the ROC curve of the probability of any, and the mean absolute and root
    mean square errors of the expected count.

    Areas come from counts by probabilities of four places, so that a window has 10,001 rows at most; ties count as half."""
    known = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    any_, q = (F.col(y) > 0).cast("double"), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(p)))
    cells = known.groupBy(*keys, F.round(p, 4).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(any_).alias("pos"),
        F.sum(F.pow(F.col(p) - any_, 2)).alias("squares"),
        F.sum(-F.when(any_ > 0, F.log(q)).otherwise(F.log(1 - q))).alias("losses"),
        F.sum(F.abs(F.col(expected) - F.col(y))).alias("off"),
        F.sum(F.pow(F.col(expected) - F.col(y), 2)).alias("off2"),
    )
    before = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    none = F.col("n") - F.col("pos")
    won = F.col("pos") * (F.coalesce(F.sum(none).over(before), F.lit(0.0)) + none / 2)
    sums = cells.withColumn("won", won).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "squares", "losses", "off", "off2", "won")])
    pairs = F.col("pos") * (F.col("n") - F.col("pos"))
    n = F.col("n")
    return sums.select(*keys, "n", (F.col("squares") / n).alias("brier"), (F.col("losses") / n).alias("log_loss"), F.when(pairs > 0, F.col("won") / pairs).alias("auc"), (F.col("off") / n).alias("mae"), F.sqrt(F.col("off2") / n).alias("rmse"))
