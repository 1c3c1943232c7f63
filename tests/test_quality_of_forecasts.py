"""Exact quantiles, trimmed moments and the sharpness curve against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bayes as B
from siltstone.operators.relational import exact_quantiles
from siltstone.operators.reports import averaging_weights


def frame(spark, x, w):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for x in (rng.random(257), np.round(rng.random(100), 1), [3.0], [1.0, 2.0]):
        got = exact_quantiles(frame(spark, x, x).union(spark.createDataFrame([(None, 1.0)], "x double, w double")), "x", 8)
        assert np.allclose(got, np.quantile(x, np.arange(9) / 8), atol=1e-12)
    assert exact_quantiles(frame(spark, [], []), "x", 4) == []


def test_trimmed_moments(spark):
    rng = np.random.default_rng(4)
    x, w = np.append(rng.normal(2, 1, 93), [50.0] * 4 + [-40.0] * 3), rng.random(100)
    got = B.trimmed_moments(frame(spark, x, w), "x", "w").first()
    # five from each end: the four of 50 and the next; the three of -40 and the next two
    order = np.argsort(x)[5:-5]
    mean = np.average(x[order], weights=w[order])
    assert got["n"] == 90 and got["mean"] == pytest.approx(mean)
    assert got["variance"] == pytest.approx(np.average((x[order] - mean) ** 2, weights=w[order]))


def test_trimmed_moments_cut_ties_alike_and_little_not_at_all(spark):
    # one of the two rows of 0 stays: half of their weight of 4 counts
    got = B.trimmed_moments(frame(spark, [0, 0, 1, 2, 9], [1, 3, 1, 1, 1]), "x", "w").first()
    assert got["n"] == 3 and got["mean"] == pytest.approx((2 * 0 + 1 + 2) / 4)
    got = B.trimmed_moments(frame(spark, [0, 0, 9], [1, 1, 1]), "x", "w").first()
    assert got["n"] == 3 and got["mean"] == pytest.approx(3) and got["variance"] == pytest.approx(18)
    got = B.trimmed_moments(frame(spark, [], []), "x", "w").first()
    assert got["n"] == 0 and got["mean"] is None and got["variance"] is None


def test_sharpness_curve_has_bins_of_equal_numbers(spark):
    rng = np.random.default_rng(6)
    width, hit = np.round(rng.gamma(2.0, 1.0, 300), 2), rng.random(300) < 0.9
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(width, hit)] + [(None, True), (1.0, None)], "width double, covered boolean")
    got = B.sharpness_curve(df, "width", "covered").orderBy("interval_width").toPandas()
    want = pd.DataFrame({"width": width, "hit": hit}).groupby(pd.qcut(width, 20, duplicates="drop"), observed=True).agg(n=("hit", "size"), w=("width", "mean"), c=("hit", "mean"))
    assert got["n"].tolist() == want["n"].tolist()
    assert np.allclose(got["interval_width"], want["w"]) and np.allclose(got["empirical_coverage"], want["c"])
    assert B.sharpness_curve(df.where("width > 1e9"), "width", "covered").count() == 0


def test_forecast_quality_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.5), (1.5, 0.0, 1.0, 0.5), (5.0, 0.0, 2.0, 0.5), (None, 0.0, 9.0, 0.5)], "x double, mean double, p double, q double")
    got = {r["metric"]: r["value"] for r in B.forecast_quality(df, "x", "mean", "p", "q", F.lit(0.25)).collect()}
    assert got["coverage_95"] == pytest.approx(2 / 3) and got["coverage_95_param_only"] == pytest.approx(1 / 3)
    assert got["mean_sharpness"] == pytest.approx(2 * 1.959964 * 4 / 3) and got["median_sharpness"] == pytest.approx(2 * 1.959964)
    assert got["sharpness_efficiency"] == pytest.approx(got["coverage_95"] / got["mean_sharpness"]) and got["crps"] == 0.25
    assert all(v is None for v in (r["value"] for r in B.forecast_quality(df.where("p > 99"), "x", "mean", "p", "q", F.lit(0.25)).collect()))


def test_models_are_weighed_within_their_family(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 5.0), ("a", "none", None), ("b", "alone", 3.0), ("c", "lost", None)], "family string, model string, score double")
    got = {r["model"]: r for r in averaging_weights(df).collect()}
    z = np.array([-1.0, 0.0, 3.0]) / (1.4826 + 1e-8)
    w = np.exp(-z) / np.exp(-z).sum()
    assert [got[m]["weight"] for m in "xyz"] == pytest.approx(w.tolist()) and all(got[m]["confident"] for m in "xyz")
    assert all(got[m]["weight"] is None for m in ("none", "alone", "lost")) and not got["alone"]["confident"] and not got["lost"]["confident"]
