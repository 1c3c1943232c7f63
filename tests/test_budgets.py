"""Shares under budgets against small linear programmes, fronts and betweenness against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import budgets as B
from siltstone.operators import spatial as G


def best_value(v, a, limit):
    """The linear programme's optimum by its vertices: all but a few sites are at 0 or 1, the others solve the tight budgets."""
    n, k, best = len(v), a.shape[1], 0.0
    for size in range(k + 1):
        for free in itertools.combinations(range(n), size):
            others = [i for i in range(n) if i not in free]
            for bits in itertools.product((0.0, 1.0), repeat=len(others)):
                x = np.zeros(n)
                x[others] = bits
                left = limit - a.T @ x
                if (left < -1e-9).any():
                    continue
                if size == 0:
                    best = max(best, v @ x)
                for tight in itertools.combinations(range(k), size) if size else ():
                    part = a[np.ix_(free, tight)].T
                    if abs(np.linalg.det(part)) < 1e-9:
                        continue
                    y = np.linalg.solve(part, left[list(tight)])
                    if (y > -1e-9).all() and (y < 1 + 1e-9).all():
                        x[list(free)] = y
                        if (a.T @ x <= limit + 1e-7).all():
                            best = max(best, v @ x)
                        x[list(free)] = 0
    return best


@pytest.mark.parametrize("seed", [1])
def test_value_and_bound_enclose_the_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    v, a = rng.integers(1, 20, 9).astype(float), rng.integers(1, 6, (9, 2)).astype(float)
    limit = np.array([8.0, 9.0])
    df = spark.createDataFrame([(i, float(v[i]), float(a[i, 0]), float(a[i, 1])) for i in range(9)], "id long, v double, x double, y double")
    out, said = B.fractional_knapsack(df, "v", {"x": "x", "y": "y"}, {"x": 8, "y": 9})
    want = best_value(v, a, limit)
    assert said["value"] - 1e-9 <= want <= said["bound"] + 1e-9
    assert said["gap"] <= 0.01
    got = {r["id"]: r["fraction"] for r in out.collect()}
    x = np.array([got[i] for i in range(9)])
    assert (x >= 0).all() and (x <= 1).all() and (a.T @ x <= limit + 1e-6).all() and v @ x == pytest.approx(said["value"])


def test_many_sites_come_within_half_a_percent(spark):
    df = spark.range(3000).selectExpr("id", "1 + pmod(hash(id), 100) as v", "1.0 + id % 7 as x", "0.5 + id % 3 as y", "cast(id % 2 as double) as z")
    out, said = B.fractional_knapsack(df, "v", {"x": "x", "y": "y", "z": "z"}, {"x": 4000, "y": 1500, "z": 10_000})
    assert said["gap"] <= 5e-3 and said["prices"]["z"] == 0.0
    used = out.agg(F.sum(F.col("x") * F.col("fraction")), F.sum(F.col("y") * F.col("fraction")), F.sum(F.col("v") * F.col("fraction"))).first()
    assert used[0] <= 4000 + 1e-6 and used[1] <= 1500 + 1e-6 and used[2] == pytest.approx(said["value"])


def test_ample_budgets_and_nothing_to_share(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, None, 1.0), (3, -1.0, None)], "id long, v double, x double")
    out, said = B.fractional_knapsack(df, "v", {"x": "x"}, {"x": 100})
    assert {r["id"]: r["fraction"] for r in out.collect()} == {1: 1.0, 2: 0.0, 3: 0.0} and said["gap"] == 0.0
    assert B.fractional_knapsack(df.limit(0), "v", {"x": "x"}, {"x": 1})[0].count() == 0


def test_pareto_front(spark):
    rnd = random.Random(4)
    plans = [(i, rnd.randrange(30), rnd.randrange(30)) for i in range(300)] + [(300, None, 40), (301, 3, None)]
    got = {r["id"] for r in B.pareto_front(spark.createDataFrame(plans, "id int, cost int, gain int").repartition(4), "cost", "gain").collect()}
    known = [p for p in plans if None not in p]
    want = {i for i, c, g in known if not any(c2 <= c and g2 >= g and (c2, g2) != (c, g) for _, c2, g2 in known)}
    assert got == want


@pytest.mark.parametrize("block", [1000, 3])
def test_betweenness(spark, block):
    rnd = random.Random(6)
    edges = {(a, b) for a in range(12) for b in rnd.sample(range(12), 2) if a != b} | {(12, 13)}
    nodes = sorted({x for e in edges for x in e})
    dist = {(s, t): 0 if s == t else None for s in nodes for t in nodes}
    ways = {(s, t): int(s == t) for s in nodes for t in nodes}
    for s in nodes:
        front, d = [s], 0
        while front:
            d, ahead = d + 1, []
            for v in front:
                for a, b in edges:
                    if a == v and dist[s, b] in (None, d):
                        if dist[s, b] is None:
                            dist[s, b] = d
                            ahead.append(b)
                        ways[s, b] += ways[s, v]
            front = ahead
    want = {}
    for v in nodes:
        total = sum(ways[s, v] * ways[v, t] / ways[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and dist[s, t] is not None and dist[s, v] is not None and dist[v, t] is not None and dist[s, v] + dist[v, t] == dist[s, t])
        want[v] = total / ((len(nodes) - 1) * (len(nodes) - 2))
    got = {r["node"]: r["betweenness"] for r in G.betweenness(spark.createDataFrame(sorted(edges), "a int, b int"), block).collect()}
    assert got == pytest.approx(want)


def test_eigenvector(spark):
    rng = np.random.default_rng(2)
    m = np.triu(rng.integers(1, 9, (6, 6)), 1)
    m = m + m.T
    edges = [(a, b, float(m[a, b])) for a in range(6) for b in range(6) if m[a, b]]
    values, vectors = np.linalg.eigh(m.astype(float))
    got = [r["eigenvector"] for r in G.eigenvector(spark.createDataFrame(edges, "a int, b int, weight double")).orderBy("node").collect()]
    assert np.allclose(got, np.abs(vectors[:, -1]), atol=1e-3)


def test_cheapest_paths_go_as_far_as_the_cutoff(spark):
    """A chain of forty cheap steps beside dear shortcuts: the cheapest way is long."""
    edges = [(i, i + 1, 0.1) for i in range(40)] + [(0, 40, 4.5), (0, 20, 1.0)]
    sources = spark.createDataFrame([(0, 99)], "node int, blocked int").withColumn("source", F.col("node"))
    got = {r["node"]: round(r["cost"], 9) for r in G.cheapest_paths(spark.createDataFrame(edges, "a int, b int, weight double"), sources, 3.5).collect()}
    assert got[40] == 3.0 and got[19] == 1.9 and got[20] == 1.0 and len(got) == 41
    near = G.cheapest_paths(spark.createDataFrame(edges, "a int, b int, weight double"), sources, 1.05).count()
    assert near == 11 + 1
