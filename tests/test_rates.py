"""Least-squares rates against sums in one piece, shrinkage by hand, and what is told of simulated series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import shrinkage as H

SCHEMA = "k string, g string, t long, m double"
MICROS = 3_600_000_000


def simulate(rng, mu, alpha, beta, hours):
    """Hours of events of one self-exciting series, by thinning."""
    out, h, a = [], 0.0, 0.0
    while True:
        top = mu + alpha * a
        gap = rng.exponential(1 / top)
        h, a = h + gap, a * math.exp(-beta * gap)
        if h > hours:
            return out
        if rng.random() * top < mu + alpha * a:
            out.append(h)
            a += 1


def naive(hours, marks, counts, beta, start, stop):
    """n, span, i1, i2, y, now of one series with distinct times in order."""
    a, sums, last = 0.0, np.zeros(6), start

    def integral(gap, rate):
        reach = min(gap, 40 / rate)
        return np.mean(np.exp(-rate * (np.arange(4000) + 0.5) * reach / 4000)) * reach

    for h, m, c in zip(hours, marks, counts):
        gap = h - last
        sums[1:4] += gap, a * integral(gap, beta), a * a * integral(gap, 2 * beta)
        a *= math.exp(-beta * gap)
        sums[0] += c
        sums[4] += c * a
        a, last = a + m, h
    gap = stop - last
    sums[1:4] += gap, a * integral(gap, beta), a * a * integral(gap, 2 * beta)
    sums[5] = a * math.exp(-beta * gap)
    return sums


def test_moments_are_those_of_one_piece(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("a", 120), ("b", 40), ("c", 1)):
        t = np.sort(rng.integers(0, 400 * MICROS, n))
        t[1::10] = t[::10][: len(t[1::10])]  # ties
        rows += [(k, "z", int(x), float(m)) for x, m in zip(t, rng.random(n))]
    df = spark.createDataFrame(rows + [(None, "z", 5, 1.0), ("a", "z", None, 1.0)], SCHEMA)
    got = H.kernel_moments(df, "k", "t", F.col("m"), (0.1, 2.0)).groupBy("k", "beta").agg(*[F.sum(c).alias(c) for c in (*H.SUMS, "now")])
    start, stop = min(r[2] for r in rows) / MICROS, max(r[2] for r in rows) / MICROS
    for r in got.collect():
        times = sorted({x[2] for x in rows if x[0] == r["k"]})
        marks = [sum(x[3] for x in rows if x[0] == r["k"] and x[2] == t) for t in times]
        counts = [sum(1 for x in rows if x[0] == r["k"] and x[2] == t) for t in times]
        want = naive([t / MICROS for t in times], marks, counts, r["beta"], start, stop)
        assert np.allclose([r[c] for c in (*H.SUMS, "now")], want, rtol=1e-4, atol=1e-9)
    assert got.count() == 6


def test_least_squares_is_the_least(spark):
    rows = [(50.0, 100.0, 30.0, 40.0, 25.0), (50.0, 100.0, 30.0, 40.0, 5.0), (10.0, 100.0, 30.0, 40.0, 60.0), (3.0, 10.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in H.SUMS))
    for r in H.least_squares(df).collect():
        n, span, i1, i2, y = [r[c] for c in H.SUMS]
        floor = H.FLOOR * n / span
        mus, alphas = np.meshgrid(np.linspace(floor, 2 * n / span, 801), np.linspace(0, 3, 801))
        grid = 2 * (mus * n + alphas * y) - (mus**2 * span + 2 * mus * alphas * i1 + alphas**2 * i2)
        assert r["gain"] >= grid.max() - 1e-9 and r["mu"] >= floor and r["alpha"] >= 0


def test_spread_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, 0.5), ("a", 8.0, 0.5), ("b", 4.0, 2.0)], "g string, x double, v double")
    got = {r["g"]: r for r in H.spread(df, ["g"], "x", "v").collect()}
    # weights 2 each: Q = 2 * 26, tau = (52 - 2) / (6 - 2)
    assert got["a"]["x_mean"] == pytest.approx(4.0) and got["a"]["x_tau"] == pytest.approx(12.5)
    assert got["b"]["x_mean"] == pytest.approx(4.0) and got["b"]["x_tau"] is None


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(H.poisson_weight(F.lit("k"), F.col("id"), F.lit(1)).alias("w"))
    r = w.agg(F.avg("w").alias("mean"), F.var_samp("w").alias("var")).first()
    assert abs(r["mean"] - 1) < 0.03 and abs(r["var"] - 1) < 0.05


def test_simulated_series_are_found(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(8):
        rows += [(f"k{i}", "calm", int(h * MICROS), 1.0) for h in simulate(rng, 0.5, 0.0, 1.0, 1500)]
        rows += [(f"x{i}", "wild", int(h * MICROS), 1.0) for h in simulate(rng, 0.3, 0.6, 1.0, 1500)]
    rows += [("few", "wild", int(h * MICROS), 1.0) for h in (3.0, 700.0, 1400.0)]
    rows += [("alone", None, int(h * MICROS), 1.0) for h in (30.0, 500.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["k"]: r for r in H.shrunk_rates(df, "k", "g", "t", F.col("m"), (0.25, 1.0, 4.0)).collect()}
    assert len(got) == 18
    for i in range(8):
        calm, wild = got[f"k{i}"], got[f"x{i}"]
        assert abs(wild["alpha"] - 0.6) < 0.15 and abs(wild["mu"] - 0.3) < 0.12 and wild["beta"] == 1.0
        assert calm["branching"] < 0.15 and abs(calm["mu"] - 0.5) < 0.1
        assert wild["low"] <= wild["high"] and wild["reliable"]
    # shrinkage brings the keys of a group together
    assert np.ptp([got[f"x{i}"]["alpha"] for i in range(8)]) <= np.ptp([got[f"x{i}"]["raw_alpha"] for i in range(8)])
    few, alone = got["few"], got["alone"]
    assert few["level"] == "group" and abs(few["alpha"] - 0.6) < 0.1 and few["high"] == pytest.approx(3 * few["fragility"])
    assert alone["group"] == "UNKNOWN" and alone["level"] == "group" and alone["mu"] > 0
    test = {r["k"]: r for r in H.local_rates(df, "k", "t", F.col("m"), (0.25, 1.0, 4.0)).collect()}
    assert all(test[f"x{i}"]["p_value"] < 1e-6 for i in range(8))
    assert sum(test[f"k{i}"]["p_value"] < 0.05 for i in range(8)) <= 2


def test_strength_and_empty_table(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "g", int(h * MICROS), 1.0) for h in simulate(rng, 0.5, 0.2, 1.0, 200)] + [("b", "g", int(h * MICROS), 1.0) for h in simulate(rng, 1.5, 0.2, 1.0, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.shrunk_rates(df, "k", "g", "t", F.col("m"), (1.0,), strength=10.0).collect()
    assert all(r["mu_weight"] == pytest.approx(r["n"] / (r["n"] + 10)) for r in got) and len(got) == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert H.shrunk_rates(empty, "k", "g", "t", F.col("m"), (1.0, 2.0)).count() == 0
    assert H.local_rates(empty, "k", "t", F.col("m"), (1.0,)).count() == 0


def test_events_reach_the_places_around(spark):
    events = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "place string, t long")
    near = spark.createDataFrame([("p", "p", 0.0), ("p", "q", 2.0), ("q", "q", 0.0)], "centre string, place string, km double")
    got = sorted((r["centre"], r["t"], r["own"], round(r["near_weight"], 6)) for r in H.near_events(events, near, "place", 2.0).collect())
    assert got == [("p", 1, 1, 1.0), ("p", 2, 0, round(math.exp(-1), 6)), ("q", 2, 1, 1.0)]
