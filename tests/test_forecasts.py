"""Frailty against a naive fit, counts against sums of their probabilities, stacks against a grid of weights, running sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.expressions import log_gamma
from siltstone.operators import counts as N
from siltstone.operators import frailty as Y
from siltstone.operators import stacking as K
from siltstone.operators.relational import running_sums


def test_log_gamma(spark):
    xs = [0.05, 0.3, 1.0, 1.5, 2.0, 7.0, 30.0, 1000.0, 1e6]
    want = [math.lgamma(x) for x in xs]
    assert log_gamma(np.array(xs), np.log) == pytest.approx(want, rel=1e-10, abs=1e-9)
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx(want, rel=1e-10, abs=1e-9)


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    values = {float(t): (float(rng.normal()), int(rng.integers(9))) for t in rng.permutation(500)}
    rows = spark.createDataFrame([(t, a, b, "x") for t, (a, b) in values.items()], "t double, a double, b long, keep string").repartition(7)
    up = {r["t"]: r for r in running_sums(rows, "t", ["a", "b"]).collect()}
    down = {r["t"]: r for r in running_sums(rows, "t", ["a"], descending=True).collect()}
    assert len(up) == len(down) == 500 and up[0.0]["keep"] == "x"
    for t in values:
        assert up[t]["a"] == pytest.approx(sum(a for s, (a, _) in values.items() if s <= t))
        assert up[t]["b"] == sum(b for s, (_, b) in values.items() if s <= t)
        assert down[t]["a"] == pytest.approx(sum(a for s, (a, _) in values.items() if s >= t)) and down[t]["b"] == values[t][1]
    assert running_sums(rows.limit(0), "t", ["a"]).count() == 0


# --- frailty
def naive_frailty(cluster, x, t, e, rounds=400):
    """Expectation-maximisation in one piece, the variance by a fine grid."""
    order = np.argsort(t)
    cluster, x, t, e = cluster[order], x[order], t[order], e[order]
    beta, z = 0.0, np.ones(cluster.max() + 1)
    d = np.bincount(cluster, e)
    logs = np.linspace(-8, 3, 4001)
    lgamma = np.vectorize(math.lgamma)
    first = np.searchsorted(t, t, "left")
    for step in range(rounds):
        for _ in range(1 if step else 20):
            r = z[cluster] * np.exp(x * beta)
            s0, s1, s2 = (np.cumsum((r * x**k)[::-1])[::-1][first] for k in range(3))
            g, h = (e * (x - s1 / s0)).sum(), (e * (s2 / s0 - (s1 / s0) ** 2)).sum()
            beta += g / h
        r = z[cluster] * np.exp(x * beta)
        s0 = np.cumsum(r[::-1])[::-1][first]
        last = np.searchsorted(t, t, "right") - 1
        hazard = np.cumsum(e / s0)[last]
        a = np.bincount(cluster, np.exp(x * beta) * hazard)
        nu = np.exp(-logs)[:, None]
        each = lgamma(nu + d) - lgamma(nu) + nu * np.log(nu) - (nu + d) * np.log(nu + a)
        theta = math.exp(logs[each.sum(axis=1).argmax()])
        if step and abs(theta - old) < 1e-9 and abs(g / h) < 1e-9:
            break
        old = theta
        z = (1 / theta + d) / (1 / theta + a)
    at = np.bincount(np.searchsorted(np.unique(t), t), e)
    log = (e * (np.log(at[np.searchsorted(np.unique(t), t)].clip(1)) - np.log(s0) + x * beta)).sum()
    return beta, theta, log + each.sum(axis=1).max(), z


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    cluster = np.repeat(np.arange(20), 15)
    x = rng.integers(0, 2, 300).astype(float)
    t = np.ceil(10 * rng.exponential(1 / (rng.gamma(1 / 0.6, 0.6, 20)[cluster] * np.exp(0.7 * x))))
    stop = np.ceil(rng.exponential(30, 300))
    return cluster, x, np.minimum(t, stop), (t <= stop).astype(int)


def frame(spark, clustered):
    rows = [(f"c{c}", float(x), float(t), int(e), 1.0) for c, x, t, e in zip(*clustered)]
    return spark.createDataFrame(rows, "c string, x double, T double, event int, weight double").repartition(3)


def test_frailty_equals_a_naive_fit(spark, clustered):
    beta, theta, ll, z = naive_frailty(*clustered)
    fit = Y.fit_frailty(frame(spark, clustered), "c", ["x"])
    assert fit.beta["x"] == pytest.approx(beta, abs=1e-3)
    assert fit.theta == pytest.approx(theta, rel=1e-2)
    assert fit.ll == pytest.approx(ll, abs=0.02)
    assert fit.ll > fit.ll_null and fit.p_value < 0.01
    got = {r["cluster"]: r["frailty"] for r in fit.clusters.collect()}
    assert [got[f"c{i}"] for i in range(20)] == pytest.approx(list(z), rel=1e-2)
    low, high = Y.variance_interval(fit)
    assert low < fit.theta < high and Y.variance_interval(fit) == (low, high)


def test_frailty_of_odd_rows(spark, clustered):
    rows = frame(spark, clustered).limit(40)
    odd = rows.unionByName(rows.limit(5).withColumn("T", F.lit(None).cast("double"))).unionByName(rows.limit(5).withColumn("c", F.lit(None).cast("string")))
    fit = Y.fit_frailty(odd, "c", [], rounds=3)
    assert fit.clusters.where("cluster is null").count() == 1 and fit.beta == {}
    none = Y.fit_frailty(rows.withColumn("event", F.lit(0)), "c", ["x"])
    assert none.theta == 0 and none.p_value == 1 and {r[0] for r in none.clusters.select("frailty").collect()} == {1.0}
    assert Y.fit_frailty(rows.limit(0), "c", ["x"]).clusters.count() == 0


# --- counts
def probabilities(mu, alpha, top=4000):
    """Of 0, 1, 2, ... by the distribution's recursion."""
    p = [(1 + alpha * mu) ** (-1 / alpha) if alpha else math.exp(-mu)]
    for y in range(1, top):
        p.append(p[-1] * (mu / y if not alpha else (y - 1 + 1 / alpha) / y * alpha * mu / (1 + alpha * mu)))
    return np.array(p)


@pytest.mark.parametrize("alpha", [0.0, 0.01, 0.4, 3.0])
def test_parts_of_positive_counts(alpha):
    for mu in (0.02, 0.7, 6.0):
        p = probabilities(mu, alpha)
        some, y = 1 - p[0], np.arange(1.0, 12.0)
        ll, slope, bend = N.truncated_parts(y, np.full(11, math.log(mu)), alpha)
        assert ll == pytest.approx(np.log(p[1:12] / some), abs=1e-7)
        up, down = (N.truncated_parts(y, np.full(11, math.log(mu) + d), alpha)[0] for d in (1e-5, -1e-5))
        assert slope == pytest.approx((up - down) / 2e-5, abs=1e-4)
        all_y = np.arange(1.0, 4000.0)
        slopes = N.truncated_parts(all_y, np.full(3999, math.log(mu)), alpha)[1]
        assert bend[0] == pytest.approx((p[1:] / some * slopes**2).sum(), rel=1e-3)


def test_hurdle_is_at_the_top(spark):
    rng = np.random.default_rng(4)
    n = 1500
    x, exposure = rng.normal(size=n), rng.normal(0, 0.3, n)
    mu = np.exp(0.8 + 0.5 * x + exposure)
    drawn = rng.poisson(rng.gamma(1 / 0.5, 0.5 * mu))
    y = np.where(rng.random(n) < 1 / (1 + np.exp(-0.4 - x)), drawn, 0)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, x, exposure)], "y long, x double, exposure double").repartition(4)
    fit = N.fit_hurdle(rows, "y", ["x"], offset="exposure")
    some = y > 0

    def likelihood(beta, alpha):
        return sum(math.log(p[k] / (1 - p[0])) for k, p in ((int(k), probabilities(m, alpha, int(k) + 1)) for k, m in zip(y[some], np.exp(beta[0] + beta[1] * x[some] + exposure[some]))))

    assert fit.ll == pytest.approx(likelihood(fit.beta, fit.alpha), abs=1e-5)
    assert 0.2 < fit.alpha < 1.0 and fit.ll > fit.ll_poisson + 10
    flat = fit.without_dispersion()
    assert flat.ll == pytest.approx(likelihood(flat.beta, 0.0), abs=1e-5) and likelihood(fit.beta, 0.0) < flat.ll
    for move in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]):
        assert likelihood(fit.beta + np.array(move), fit.alpha) < fit.ll
    assert all(likelihood(fit.beta, fit.alpha * a) < fit.ll for a in (0.8, 1.25))
    odds = lambda g: np.where(some, -np.log1p(np.exp(-(g[0] + g[1] * x))), -np.log1p(np.exp(g[0] + g[1] * x))).sum()
    assert all(odds(fit.gamma) > odds(fit.gamma + np.array(m)) for m in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]))
    said = rows.select(fit.any().alias("p"), fit.positive_mean().alias("m"), "x", "exposure", "y").limit(20).collect()
    for r in said:
        p = probabilities(math.exp(fit.beta[0] + fit.beta[1] * r["x"] + r["exposure"]), fit.alpha)
        assert r["m"] == pytest.approx((np.arange(len(p)) * p).sum() / (1 - p[0]), rel=1e-6)


def test_hurdle_of_odd_rows(spark):
    rows = spark.createDataFrame([(0, 1.0), (None, 2.0), (3, None), (2, 0.5)], "y long, x double")
    fit = N.fit_hurdle(rows, "y", ["x"])
    assert rows.select(fit.expected().alias("e")).where("e is null or e <= 0").count() == 0
    none = N.fit_hurdle(rows.limit(0), "y", ["x"])
    assert rows.select(none.any().alias("p")).first()["p"] == pytest.approx(0.5)
    full = N.fit_hurdle(spark.createDataFrame([(i % 7 + 1, float(i % 3)) for i in range(200)], "y long, x double"), "y", ["x"])
    assert rows.select(full.any().alias("p")).first()["p"] > 0.99


def test_scores(spark):
    rng = np.random.default_rng(5)
    p, y = rng.random(400).round(2), rng.integers(0, 3, 400)
    p = np.clip(p, 0.01, 0.99)
    rows = spark.createDataFrame([("a", float(a), 2 * float(a), int(b)) for a, b in zip(p, y)] + [("b", 0.5, 1.0, 0), ("b", None, 1.0, 1)], "m string, p double, e double, y long")
    got = {r["m"]: r for r in N.forecast_scores(rows, ["m"], "p", "e", "y").collect()}
    pos = y > 0
    pairs = (p[pos][:, None] > p[~pos]).sum() + 0.5 * (p[pos][:, None] == p[~pos]).sum()
    a = got["a"]
    assert (a["n"], got["b"]["n"], got["b"]["auc"]) == (400, 1, None)
    assert a["auc"] == pytest.approx(pairs / (pos.sum() * (~pos).sum()))
    assert a["brier"] == pytest.approx(((p - pos) ** 2).mean())
    assert a["log_loss"] == pytest.approx(-np.where(pos, np.log(p), np.log(1 - p)).mean())
    assert a["mae"] == pytest.approx(abs(2 * p - y).mean()) and a["rmse"] == pytest.approx(((2 * p - y) ** 2).mean() ** 0.5)


# --- stacks
def test_weights_equal_a_grid():
    rng = np.random.default_rng(6)
    steps = [(i / 50, j / 50, 1 - (i + j) / 50) for i in range(51) for j in range(51 - i)]
    for _ in range(20):
        x = rng.normal(size=(60, 3)) + rng.normal(size=(60, 1))
        y = x @ rng.normal(size=3) + rng.normal(size=60)
        w = K.simplex_weights(x.T @ x / 60, x.T @ y / 60)
        assert w.sum() == pytest.approx(1) and w.min() >= 0
        error = lambda v: ((y - x @ np.array(v)) ** 2).mean()
        assert error(w) <= min(map(error, steps)) + 1e-9
    same = np.ones((2, 2))
    assert K.simplex_weights(same, np.ones(2)).sum() == pytest.approx(1)


def test_stack_is_no_worse_than_its_best_part(spark):
    rng = np.random.default_rng(7)
    x, group = rng.normal(size=1200), rng.integers(0, 5, 1200)
    y = x + group + rng.normal(0, 0.5, 1200)
    rows = spark.createDataFrame([(i, float(x[i]), int(group[i]), float(y[i])) for i in range(1200)], "id long, x double, g long, y double").repartition(3)
    rows = rows.unionByName(rows.limit(3).withColumn("y", F.lit(None).cast("double")))
    from siltstone.plans.q_forecasts import linear_learner, mean_learner

    nothing = lambda rows: lambda others, name: others.withColumn(name, F.lit(None).cast("double"))
    learners = {"line": linear_learner(["x"]), "group": mean_learner("g"), "nothing": nothing}
    train, held = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0 and y is not null")
    stack = K.fit_stack(train, "id", F.col("y"), learners)
    assert sum(stack.weights.values()) == pytest.approx(1) and stack.weights["line"] > 0.2 < stack.weights["group"]
    assert stack.errors["stacked"] <= min(v for k, v in stack.errors.items() if k != "stacked")
    assert K.fit_stack(train.repartition(5), "id", F.col("y"), learners).weights == pytest.approx(stack.weights, abs=1e-9)
    models = {k: v for k, v in stack.models.items() if k != "nothing"}
    if stack.weights["nothing"] < 1e-9:
        stack.weights, stack.models = {k: stack.weights[k] for k in models}, models
        said = stack.predict(held.withColumn("label__", F.col("y")))
        e = said.agg(*[F.avg(F.pow(F.col(c) - F.col("y"), 2)).alias(c) for c in ("line", "group", "stacked")]).first()
        assert e["stacked"] <= min(e["line"], e["group"])
    with pytest.raises(ValueError):
        K.fit_stack(train.limit(0), "id", F.col("y"), {"group": mean_learner("g")})
