"""The survival forest: splits against brute force, hazards against a naive count, concordance against Cox."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import forest as R
from siltstone.operators import scenarios as C
from siltstone.operators import survival as S


def naive_log_rank(left, times, events):
    u = v = 0.0
    for t in sorted(set(times[events == 1])):
        n, nl = (times >= t).sum(), (left & (times >= t)).sum()
        d, dl = ((times == t) & (events == 1)).sum(), (left & (times == t) & (events == 1)).sum()
        u += dl - d * nl / n
        if n > 1:
            v += d * nl / n * (1 - nl / n) * (n - d) / (n - 1)
    return u * u / v if v > 1e-12 else 0.0


def test_splits_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(5, 80))
        x, t, e = rng.integers(0, 6, (n, 2)), rng.integers(0, 9, n), rng.integers(0, 2, n)
        rows, events = np.zeros((2, 6, 9), np.int64), np.zeros((2, 6, 9), np.int64)
        for j in range(2):
            np.add.at(rows[j], (x[:, j], t), 1)
            np.add.at(events[j], (x[:, j], t), e)
            want = [naive_log_rank(x[:, j] <= b, t, e) if 0 < (x[:, j] <= b).sum() else 0.0 for b in range(5)]
            assert np.allclose(R.log_rank(events[j], rows[j]), want)
        chi = np.array([[naive_log_rank(x[:, j] <= b, t, e) if min((x[:, j] <= b).sum(), (x[:, j] > b).sum()) >= 3 else 0.0 for b in range(5)] for j in range(2)])
        got = R.best_split(events, rows, 3)
        assert got is None if chi.max() == 0 else chi[got] == pytest.approx(chi.max())


@pytest.fixture(scope="module")
def curved(spark):
    """Hazards high at both ends of x, which no single coefficient can say; y is noise."""
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-2, 2, 3000), rng.normal(size=3000)
    t = rng.exponential(1 / np.exp(x * x - 1))
    c = rng.exponential(2.0, 3000)
    rows = [(i, float(x[i]), float(y[i]), float(np.minimum(t, c)[i]), int(t[i] <= c[i])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, x double, y double, T double, event int").withColumn("weight", F.lit(1.0)).repartition(3).cache()


def test_concordance_beats_proportional_hazards(curved):
    train, held = curved.where("id % 3 <> 0"), curved.where("id % 3 = 0")
    forest = R.fit_forest(train, "id", "T", F.col("event") == 1, ["x", "y"], trees=20, draws=2)
    score = lambda rows: S.concordance(rows, "risk").first()["c_index"]
    ours = score(held.withColumn("risk", forest.predict()["risk"]))
    beta = C.cox_fit(train, ["x", "y"])
    cox = score(held.withColumn("risk", F.col("x") * beta["x"] + F.col("y") * beta["y"]))
    assert ours > 0.65 > cox
    importance = dict(R.permutation_importance(held, forest, "id", score))
    assert importance["x"] > 0.1 > abs(importance["y"])


def test_hazards_and_reruns(curved):
    one = R.fit_forest(curved, "id", "T", F.col("event") == 1, ["x", "y"], trees=2, depth=1, draws=1, cells=8)
    two = R.fit_forest(curved.repartition(5), "id", "T", F.col("event") == 1, ["x", "y"], trees=2, depth=1, draws=1, cells=8)
    assert np.array_equal(one.hazard, two.hazard) and np.array_equal(one.bin, two.bin)
    rows = curved.select("id", F.xxhash64("id").alias("h"), "x", "y", "T", "event").toPandas()
    bins = one.bins(rows[["x", "y"]].to_numpy())
    cell = np.searchsorted(one.times, rows["T"])
    for t in range(2):
        w = R.drawn_weights(rows["h"].to_numpy(), t, 42)
        assert 0.9 < w.mean() < 1.1
        right = bins[:, one.feature[t][0]] > one.bin[t][0]
        for leaf in (0, 1):
            mine, total = right == bool(leaf), 0.0
            for k in range(len(one.times)):
                risk = (w * (mine & (cell >= k))).sum()
                total += (w * rows["event"] * (mine & (cell == k))).sum() / risk if risk else 0.0
                assert one.hazard[t][leaf][k] == pytest.approx(total)


def test_missing_and_empty(curved, spark):
    odd = curved.limit(50).withColumn("x", F.lit(None).cast("double")).withColumn("T", F.when(F.col("id") % 2 == 0, F.col("T")))
    forest = R.fit_forest(odd, "id", "T", F.col("event") == 1, ["x", "y"], trees=2)
    assert odd.withColumn("p", forest.predict()).where("p.risk is null").count() == 0
    none = R.fit_forest(odd.limit(0), "id", "T", F.col("event") == 1, ["x"], trees=1)
    assert odd.limit(1).select(none.predict().alias("p")).first()["p"]["risk"] == 0.0
