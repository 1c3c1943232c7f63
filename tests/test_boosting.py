"""The tree learner against a naive one, attribution against enumeration, coverage on held-out rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import boosting as B


def naive(x, y, losses, rounds, depth, rate, edges, least):
    """The same learner row by row: recursive trees, sums by masks."""
    bins = np.stack([[sum(v > e for e in edges[j]) if v == v else 0 for v in x[:, j]] for j in range(x.shape[1])], axis=1)
    span, middle = max(y.max() - y.min(), 1e-9), (y.max() + y.min()) / 2

    def leaf(loss, r):
        if not len(r):
            return 0.0
        if isinstance(loss, B.Huber):
            return float(np.mean([round(max(-1, min(1, v / loss.delta)) * B.UNIT) for v in r])) * loss.delta / B.UNIT
        cells = sorted(min(B.GRID - 1, max(0, math.floor((v + span) / (2 * span) * B.GRID))) for v in r)
        want, met = loss.q * len(cells), 0
        for cell in sorted(set(cells)):
            here = cells.count(cell)
            if met + here >= want:
                return (cell + (want - met) / here) / B.GRID * 2 * span - span
            met += here

    def gradient(loss, v):
        if isinstance(loss, B.Huber):
            return round(max(-1, min(1, v / loss.delta)) * B.UNIT)
        return round(loss.q * B.UNIT) if v > 0 else round((loss.q - 1) * B.UNIT)

    def grow(loss, rows, r, left):
        if left:
            g = [gradient(loss, r[i]) for i in rows]
            best, found = (sum(g) ** 2 / len(rows) if rows else 0) * (1 + 1e-12), None
            for j in range(x.shape[1]):
                for b in range(255):
                    low = [k for k, i in enumerate(rows) if bins[i, j] <= b]
                    if min(len(low), len(rows) - len(low)) < least:
                        continue
                    gl = sum(g[k] for k in low)
                    gain = float(gl) ** 2 / len(low) + float(sum(g) - gl) ** 2 / (len(rows) - len(low))
                    if gain > best:
                        best, found = gain, (j, b)
            if found:
                j, b = found
                return (*found, grow(loss, [i for i in rows if bins[i, j] <= b], r, left - 1), grow(loss, [i for i in rows if bins[i, j] > b], r, left - 1))
        return leaf(loss, [r[i] for i in rows])

    def said(tree, i):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[i, tree[0]] <= tree[1] else tree[3]
        return tree

    out = []
    for loss in losses:
        f = np.full(len(y), middle)
        f += leaf(loss, y - f)
        for _ in range(rounds):
            tree = grow(loss, list(range(len(y))), y - f, depth)
            f = f + rate * np.array([said(tree, i) for i in range(len(y))])
        out.append(f)
    return np.stack(out, axis=1)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 3)), 1)
    x[::17, 1] = np.nan
    y = 2 * x[:, 0] + (np.nan_to_num(x[:, 1]) > 0.3) * x[:, 2] + rng.exponential(1, 500)
    rows = [(i, *[None if v != v else float(v) for v in x[i]], float(y[i])) for i in range(500)]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(3)


LOSSES = [B.Pinball(0.5), B.Pinball(0.9), B.Huber(0.7)]


def test_equals_a_naive_learner(sample):
    x, y, df = sample
    model = B.fit_boosted(df, F.col("y"), ["a", "b", "c"], LOSSES, rounds=4, depth=2, max_bins=8, least=10, rewrite=2)
    got = np.array([r["p"] for r in df.withColumn("p", model.predict()).orderBy("id").collect()])
    want = naive(x, y, LOSSES, 4, 2, 0.3, model.edges, 10)
    assert np.allclose(got, want, atol=1e-9)


def test_attribution_adds_up_and_equals_enumeration(sample):
    x, y, df = sample
    model = B.fit_boosted(df, F.col("y"), ["a", "b", "c"], LOSSES, rounds=3, depth=3, max_bins=16, least=5)
    bins = model.bins(x)
    parts = sum(B.attribution(t, bins) for t in model.trees[1])
    mean = sum(B.mean_margin(t) for t in model.trees[1])
    assert np.allclose(parts.sum(axis=1), model.margins(bins)[:, 1] - mean)
    assert np.allclose(mean, model.margins(bins)[:, 1].mean())

    def known(tree, row, features, at=0):
        """What the tree says when it knows some features only: over the others it averages by its train rows."""
        if at >= len(tree.feature):
            return tree.value[at - len(tree.feature)]
        low, high = 2 * at + 1, 2 * at + 2
        if tree.feature[at] in features:
            return known(tree, row, features, high if row[tree.feature[at]] > tree.bin[at] else low)
        if not tree.cover[at]:
            return 0.0
        return (tree.cover[low] * known(tree, row, features, low) + tree.cover[high] * known(tree, row, features, high)) / tree.cover[at]

    got = [r["p"] for r in df.withColumn("p", model.attribute(1)).orderBy("id").collect()]
    for i in range(0, 500, 41):
        for j in range(3):
            want = 0.0
            others = [k for k in range(3) if k != j]
            for size in range(3):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(2 - size) / 6
                    want += w * sum(known(t, bins[i], {*s, j}) - known(t, bins[i], set(s)) for t in model.trees[1])
            assert got[i][j] == pytest.approx(want, abs=1e-9)


def test_missing_labels_constant_features_and_empty_tables(spark, sample):
    _, _, df = sample
    odd = df.select("id", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), F.when(F.col("id") % 2 == 0, F.col("y")).alias("y"))
    model = B.fit_boosted(odd, F.col("y"), ["a", "b"], [B.Pinball(0.5)], rounds=2)
    said = {round(r["p"][0], 9) for r in odd.withColumn("p", model.predict()).collect()}
    assert len(said) == 1
    assert B.fit_boosted(odd.limit(0), F.col("y"), ["a", "b"], [B.Pinball(0.5)]).trees == [[]]
    assert [r["p"] for r in odd.limit(1).withColumn("p", B.fit_boosted(odd.limit(0), F.col("y"), ["a"], [B.Huber(1.0)]).predict()).collect()] == [[0.0]]


def test_target_means(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 1), (None, 7.0, 1), ("c", 9.0, 0)], "g string, y double, t int")
    got = {r["g"]: r["g__mean"] for r in B.target_means(df, F.col("t") == 1, "g", F.col("y"), strength=2).collect()}
    assert got == {"a": pytest.approx((4 + 8) / 4), "b": pytest.approx((5 + 8) / 3), None: pytest.approx((7 + 8) / 3), "c": 4.0}


def test_held_out_coverage_and_drivers(spark):
    import os

    from siltstone.plans.all import QUERIES

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = QUERIES["boosted_duration_quantiles"](spark, folder).collect()
    n = sum(r["n"] for r in got)
    for p in (50, 80, 95):
        assert sum(r["n"] * r[f"covered_p{p}"] for r in got) / n == pytest.approx(p / 100, abs=0.02)
    assert all(r["p50"] <= r["p80"] <= r["p95"] for r in got)
    rows = QUERIES["duration_drivers"](spark, folder).collect()
    assert len(rows) == n and all(abs(r["part1"]) >= abs(r["part2"]) >= abs(r["part3"]) for r in rows)
