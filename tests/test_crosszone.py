"""The joint fit across zones against a one-piece fit, its errors and its test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import crosszone as Z
from siltstone.operators.temporal import HOUR

SOURCES = {"a": ["b"], "b": ["a", "c"], "c": []}


@pytest.fixture(scope="module")
def spread():
    """Zone b follows events of a within hours; c is on its own. Some events share a time."""
    rng = np.random.default_rng(8)
    a = rng.uniform(0, 600, 150)
    b = np.concatenate([rng.uniform(0, 600, 60), (a + rng.exponential(1.5, 150))[rng.random(150) < 0.6]])
    c = rng.uniform(0, 600, 80)
    rows = [(z, int(round(h, 2) * HOUR), round(float(m), 2)) for z, hs in zip("abc", (a, b, c)) for h, m in zip(hs, rng.uniform(0.5, 1, len(hs)))]
    rows += [("b", rows[0][1], 0.7), (None, 5, 1.0)]
    return [(i, *r) for i, r in enumerate(rows)]


def one_piece(rows, beta, shrink, cross=True):
    """theta by zone by multiplicative steps (without penalty) or by gradient ascent, from sums over all pairs of events."""
    rows = [r for r in rows if r[1] is not None]
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    out = {}
    for v, us in SOURCES.items():
        names = [v, *(us if cross else [])]
        mine = [r for r in rows if r[1] == v]
        x = np.array([[1.0] + [sum(s[3] * math.exp(-beta * (r[2] - s[2]) / HOUR) for s in rows if s[1] == u and s[2] < r[2]) for u in names] for r in mine])
        c = np.array([(high - low) / HOUR] + [sum(s[3] * (1 - math.exp(-beta * (high - s[2]) / HOUR)) for s in rows if s[1] == u) / beta for u in names])
        pen = np.array([0.0, 0.0] + [shrink / len(mine)] * (len(names) - 1))
        theta = 0.3 * len(mine) / c / len(c)
        for _ in range(20000):  # a fixed point of the penalised likelihood's conditions
            theta = theta * (x / (x @ theta)[:, None]).sum(axis=0) / (c + 2 * pen * theta)
        rate = x @ theta
        out[v] = theta, np.log(rate).sum() - c @ theta, (x[:, :, None] * x[:, None, :] / (rate**2)[:, None, None]).sum(axis=0)
    return out


def test_equals_a_one_piece_fit(spark, spread):
    df = spark.createDataFrame(spread, "event_id long, zone string, t long, m double").repartition(3)
    got = {(r["source_zone"], r["receiver_zone"]): r for r in Z.fit_cross_zone(df, SOURCES, "zone", "t", F.col("m"), betas=(0.1, 0.7), tolerance=1e-12).collect()}
    assert set(got) == {("a", "a"), ("b", "a"), ("b", "b"), ("a", "b"), ("c", "b"), ("c", "c")}
    fits = {beta: one_piece(spread, beta, 0.5) for beta in (0.1, 0.7)}
    beta = max(fits, key=lambda b: sum(f[1] for f in fits[b].values()))
    alone = one_piece(spread, beta, 0.0, cross=False)
    for v, us in SOURCES.items():
        theta, ll, curve = fits[beta][v]
        errors = np.sqrt(np.diag(np.linalg.inv(curve)))
        for k, u in enumerate([v, *us]):
            r = got[u, v]
            assert r["beta"] == beta and r["half_life_hours"] == pytest.approx(math.log(2) / beta)
            assert r["alpha"] == pytest.approx(theta[k + 1], abs=2e-4)
            if theta[k + 1] > 1e-3:
                assert r["se"] == pytest.approx(errors[k + 1], rel=0.02)
            assert r["lr"] == pytest.approx(max(0.0, 2 * (ll - alone[v][1])), abs=2e-3)
    assert got["a", "b"]["ci_low"] > 0 and got["a", "b"]["p_value"] < 1e-6
    assert got["c", "b"]["ci_low"] == 0 and got["c", "c"]["p_value"] == 1.0


def test_chi_square_tails():
    # tables: 5 % points
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.06714)):
        assert Z.chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def test_empty(spark):
    df = spark.createDataFrame([], "event_id long, zone string, t long, m double")
    assert Z.fit_cross_zone(df, SOURCES, "zone", "t", F.col("m")).count() == 0


def test_few_rounds_where_many_terms_are_none(spark, monkeypatch):
    """Five zones of events drawn evenly: half of the terms lie at their bound, and Newton steps still end in a few rounds."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(5)), int(h * HOUR), 0.5) for i, h in enumerate(rng.uniform(0, 700, 1500))]
    df = spark.createDataFrame(rows, "event_id long, zone long, t long, m double")
    rounds, sums = [], Z._sums
    monkeypatch.setattr(Z, "_sums", lambda *a: rounds.append(1) or sums(*a))
    got = Z.fit_cross_zone(df, {z: [(z + 4) % 5, (z + 1) % 5] for z in range(5)}, "zone", "t", F.col("m"), betas=(0.05, 0.5, 5.0))
    assert got.count() == 15 and got.where("alpha = 0").count() > 2
    assert len(rounds) <= 15


def test_sums_over_parts_batches_and_shared_times(spark):
    """Each event counts, those of one time together, also where every batch has a few cells and each part its own range."""
    rng = np.random.default_rng(6)
    hours = np.sort(np.append(rng.uniform(0, 40, 90).round(), [5000.0, 5001.0]))
    rows = [(int(rng.integers(3)), int(h * HOUR), float(rng.integers(1, 9)) if k % 5 else None) for k, h in enumerate(hours)]
    listed, betas = {0: [0, 2], 1: [1, 0]}, (0.1, 9.0)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.createDataFrame(rows, "zone int, t long, m double").repartition(3)
        got = [(r["zone"], np.frombuffer(r["n"]), np.frombuffer(r["x"]).reshape(2, 2, -1)) for r in Z.kernel_vectors(df, listed, "t", F.col("m"), betas, rows[0][1]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    found = sorted((z, *np.round(x[:, :, i].ravel(), 9)) for z, n, x in got for i in range(len(n)) for _ in range(int(n[i])))
    want = sorted((v, *[round(sum((m or 0.0) * math.exp(-b * (t - s) / HOUR) for u, s, m in rows if u == w and s < t), 9) for b in betas for w in listed[v]]) for v, t, _ in rows if v in listed)
    assert np.allclose(found, want, atol=1e-8) and len(found) == len(want)


def test_bounded_steps_against_all_sets():
    """The best of the solutions over every set of parameters that are left off their bound."""
    rng = np.random.default_rng(7)
    for size in (1, 2, 4, 4, 4):
        h, g, room = rng.normal(size=(size + 2, size)), 3 * rng.normal(size=size), rng.uniform(0, 1, size) * (rng.random(size) < 0.7)
        h = h.T @ h * np.outer(s := 10.0 ** rng.uniform(-3, 3, size), s)
        best = -np.inf
        for off in range(1 << size):
            off = np.array([bool(off >> i & 1) for i in range(size)])
            d = -room.copy()
            if off.any():
                d[off] = np.linalg.solve(h[np.ix_(off, off)], g[off] - h[np.ix_(off, ~off)] @ d[~off])
            if (d >= -room - 1e-12).all():
                best = max(best, g @ d - d @ h @ d / 2)
        d = Z.bounded_step(h, g, room)
        assert (d >= -room - 1e-9).all() and g @ d - d @ h @ d / 2 == pytest.approx(best, rel=1e-6, abs=1e-9)
