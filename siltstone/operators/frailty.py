"""Shared gamma frailty: proportional hazards whose clusters differ by a random factor."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import log_gamma
from siltstone.operators.forest import drawn_weights
from siltstone.operators.relational import running_sums, value_ranks
from siltstone.sources.scratch import written

#: Log variances between which the frailties' variance is sought, and how many are tried at once.
LOWEST, HIGHEST, TRIED = -10.0, 3.0, 53


@dataclass
class Frailty:
    """beta by column, the frailties' variance, the marginal log-likelihoods with and without frailties, and a written
    table of clusters: cluster, d (events), a (expected events without frailty), frailty; and how many rounds it took."""

    beta: dict[str, float]
    theta: float
    ll: float
    ll_null: float
    clusters: DataFrame
    rounds: int = 0

    @property
    def lr(self) -> float:
        return max(0.0, 2 * (self.ll - self.ll_null))

    @property
    def p_value(self) -> float:
        """Of no variance, which lies at the edge of what is possible: half of one chi square's tail."""
        return 0.5 * math.erfc(math.sqrt(self.lr / 2)) if self.lr > 0 else 1.0


def cluster_likelihoods(d: np.ndarray, a: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """[cluster, theta]: what a cluster of d events and a expected ones adds to the marginal log-likelihood, less what it adds
    to that of no variance."""
    nu, d, a = 1 / thetas[None, :], d[:, None], a[:, None]
    return log_gamma(nu + d, np.log) - log_gamma(nu, np.log) - d * np.log(nu) - (nu + d) * np.log1p(a / nu) + a


def _best(sums: np.ndarray, logs: np.ndarray) -> tuple[float, float]:
    """Where a curve given on an even grid is highest, and how high: the top of the parabola through its best three points."""
    i = int(np.argmax(sums))
    if 0 < i < len(logs) - 1:
        left, mid, right = sums[i - 1 : i + 2]
        bend = left - 2 * mid + right
        if bend < 0:
            move = 0.5 * (left - right) / bend
            return float(logs[i] + move * (logs[1] - logs[0])), float(mid - 0.25 * (left - right) * move)
    return float(logs[i]), float(sums[i])


def _profile(clusters: DataFrame, logs: np.ndarray, draws: int = 0, seed: int = 42) -> np.ndarray:
    """[draw, theta]: the clusters' likelihoods summed, as they are in row 0 and weighted by each bootstrap's draws in the others.

    A task sends one row for each sum, whatever its number of clusters."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((draws + 1, len(logs)))
        for batch in batches:
            d, a, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            each = cluster_likelihoods(d, a, np.exp(logs))
            total[0] += each.sum(axis=0)
            for b in range(draws):
                total[b + 1] += drawn_weights(h, b, seed) @ each
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["slot", "value"])

    out = np.zeros((draws + 1) * len(logs))
    for slot, value in clusters.select("d", "a", F.xxhash64("cluster")).mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value")).collect():
        out[slot] = value
    return out.reshape(draws + 1, len(logs))


def fit_frailty(rows: DataFrame, cluster: str, numeric: Sequence[str], *, rounds: int = 60, tolerance: float = 1e-4, reach: float = 1.6) -> Frailty:
    """Coefficients, variance and frailties of clusters from columns T, event, weight, by expectation-maximisation.

    Each round moves the logarithms of the frailties towards their expectation, `reach` times as far, and takes a Newton step of
    the partial likelihood with them, then the Breslow hazard, then the variance that suits the clusters' events and expected events best. Rows are summed by cluster,
    time and covariates first, so that rounds run over these cells; risk sets are summed by ranges of time that are dealt once. Rows with a
    null time, weight or covariate go; a null cluster is a cluster. Without events there is nothing to fit: all
    coefficients and the variance are 0 and all frailties 1.
    """
    known = rows.where(F.col("T").isNotNull() & F.col("weight").isNotNull())
    for c in numeric:
        known = known.where(F.col(c).isNotNull())
    x = [f"x{i}" for i in range(len(numeric))]
    pairs = [(i, j) for i in range(len(numeric)) for j in range(i, len(numeric))]
    cells = known.groupBy(F.col(cluster).alias("cluster"), F.col("T").cast("double").alias("T"), *[F.col(c).cast("double").alias(n) for c, n in zip(numeric, x, strict=True)])
    cells = written(cells.agg(F.sum("weight").cast("double").alias("w"), F.sum(F.when(F.col("event") == 1, F.col("weight")).otherwise(0.0)).cast("double").alias("e")).where("w > 0"), "frailty_cells")
    cells = written(cells.join(value_ranks(cells, "T").select("T", "part"), "T"), "frailty_parts")
    events = cells.groupBy("cluster").agg(F.sum("e").alias("d"))
    clusters = written(events.select("cluster", "d", F.col("d").alias("a"), F.lit(1.0).alias("frailty")), "frailty")
    total = cells.agg(F.sum("e")).first()[0] or 0.0
    if not total:
        return Frailty(dict.fromkeys(numeric, 0.0), 0.0, 0.0, 0.0, clusters)

    def pass_over(beta: np.ndarray, frailties: DataFrame) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
        """The gradient, the information, the events' log hazards summed, and the clusters' events and expected events."""
        score = sum((F.col(n) * float(b) for n, b in zip(x, beta, strict=True)), F.lit(0.0))
        scored = cells.withColumn("u", F.col("w") * F.exp(score)).withColumn("score", score)
        at_risk = scored.join(frailties.select(F.col("cluster").alias("c"), "frailty"), F.col("cluster").eqNullSafe(F.col("c"))).withColumn("r", F.col("u") * F.col("frailty"))
        first = [F.sum(F.col("r") * F.col(n)).alias(f"s{i}") for i, n in enumerate(x)]
        second = [F.sum(F.col("r") * F.col(x[i]) * F.col(x[j])).alias(f"s{i}_{j}") for i, j in pairs]
        times = at_risk.groupBy("part", "T").agg(F.sum("e").alias("e"), F.sum(F.col("e") * F.col("score")).alias("escore"), *[F.sum(F.col("e") * F.col(n)).alias(f"e{i}") for i, n in enumerate(x)], F.sum("r").alias("s"), *first, *second)
        names = ["s", *[f"s{i}" for i in range(len(x))], *[f"s{i}_{j}" for i, j in pairs]]
        risk = written(running_sums(written(times, "frailty_times"), "T", names, descending=True, part="part"), "frailty_risk")
        at_events = risk.where("e > 0")
        gradient = [F.sum(F.col(f"e{i}") - F.col("e") * F.col(f"s{i}") / F.col("s")).alias(f"g{i}") for i in range(len(x))]
        bend = [F.sum(F.col("e") * (F.col(f"s{i}_{j}") / F.col("s") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("s") * F.col("s")))).alias(f"h{i}_{j}") for i, j in pairs]
        got = at_events.agg(F.sum(F.col("e") * F.log(F.col("e") / F.col("s")) + F.col("escore")).alias("log"), *gradient, *bend).first()
        information = np.zeros((len(x), len(x)))
        for i, j in pairs:
            information[i, j] = information[j, i] = got[f"h{i}_{j}"]
        hazard = running_sums(risk.select("part", "T", F.when(F.col("e") > 0, F.col("e") / F.col("s")).otherwise(0.0).alias("hazard")), "T", ["hazard"], part="part").select("T", "hazard")
        found = scored.join(hazard, "T").groupBy("cluster").agg(F.sum("e").alias("d"), F.sum(F.col("u") * F.col("hazard")).alias("a"))
        return np.array([got[f"g{i}"] for i in range(len(x))]), information, got["log"], written(found, "frailty_sums")

    def step(beta: np.ndarray, gradient: np.ndarray, information: np.ndarray) -> np.ndarray:
        return beta + np.linalg.solve(information + 1e-9 * np.eye(len(x)), gradient) if len(x) else beta

    # without frailties first: where the coefficients start, and the likelihood to hold the other against
    beta, ones = np.zeros(len(x)), clusters
    for _ in range(12):
        gradient, information, log, sums = pass_over(beta, ones)
        moved = step(beta, gradient, information)
        if not len(x) or np.abs(moved - beta).max() < 1e-7:
            break
        beta = moved
    ll_null = log - total
    grid = np.linspace(LOWEST, HIGHEST, TRIED)
    place, _ = _best(_profile(sums, grid)[0], grid)
    passes = 0
    for _ in range(rounds):
        nu = math.exp(-place)
        said = sums.join(clusters.select(F.col("cluster").alias("c"), F.col("frailty").alias("old")), F.col("cluster").eqNullSafe(F.col("c")))
        further = F.col("old") * F.pow((nu + F.col("d")) / (nu + F.col("a")) / F.col("old"), reach)
        clusters = written(said.select("cluster", "d", "a", further.alias("frailty")), "frailty")
        gradient, information, log, sums = pass_over(beta, clusters)
        near = np.linspace(max(LOWEST, place - 0.5), min(HIGHEST, place + 0.5), 21)
        best, gain = _best(_profile(sums, near)[0], near)
        moved = step(beta, gradient, information)
        passes += 1
        change = max(abs(math.exp(best) - math.exp(place)) / max(math.exp(place), 1e-2), np.abs(moved - beta).max() if len(x) else 0.0)
        place = best
        if change < tolerance:
            break
        beta = moved
    # the sums of expected events that the gain takes off again stand in for those of no variance
    expected = sums.agg(F.sum("a")).first()[0]
    nu = math.exp(-place)
    clusters = written(sums.withColumn("frailty", (nu + F.col("d")) / (nu + F.col("a"))), "frailty")
    return Frailty(dict(zip(numeric, beta.tolist(), strict=True)), math.exp(place), log + gain - expected, ll_null, clusters, passes)


def variance_interval(fit: Frailty, *, draws: int = 200, low: float = 0.05, high: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Quantiles of the variance over bootstraps that draw whole clusters, coefficients and hazard held: all in one pass."""
    logs = np.linspace(LOWEST, HIGHEST, 4 * TRIED)
    found = [math.exp(_best(row, logs)[0]) for row in _profile(fit.clusters, logs, draws, seed)[1:]]
    return float(np.quantile(found, low)), float(np.quantile(found, high))
