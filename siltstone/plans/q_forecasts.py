"""Queries: frailties of corridors, forecasts of counts beside their baselines, stacked durations, intensity on the hours."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import boosting as B
from siltstone.operators import counts as N
from siltstone.operators import frailty as Y
from siltstone.operators import incidents as I
from siltstone.operators import learning as L
from siltstone.operators import pointprocess as P
from siltstone.operators import stacking as K
from siltstone.operators import temporal as M
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6
from siltstone.sources.scratch import written


# --- frailty of corridors over the durations of shipments
def _frailty(spark, sf):
    rows = I.shipments(spark, sf).where("duration >= 0").select(
        "corridor", F.col("duration").alias("T"), (~F.col("is_censored")).cast("int").alias("event"), F.lit(1.0).alias("weight"), F.col("priority").isin("1-URGENT", "2-HIGH").cast("double").alias("urgent"), (F.month("start_ts") / 12).alias("season")
    )
    return Y.fit_frailty(rows, "corridor", ["urgent", "season"])


def frailty_effects(spark, sf):
    """Of each corridor its events, the expected ones and its frailty: how much faster it ends incidents."""
    return _frailty(spark, sf).clusters.select("cluster", F.round("d", 3).alias("events"), F.round("a", 3).alias("expected"), F.round("frailty", 4).alias("frailty"))


def frailty_test(spark, sf):
    """The frailties' variance with its interval over resampled corridors, and the test of no variance."""
    fit = _frailty(spark, sf)
    low, high = Y.variance_interval(fit)
    row = {"theta": fit.theta, "low": low, "high": high, "ll": fit.ll, "ll_null": fit.ll_null, "lr": fit.lr, "p_value": fit.p_value, **{f"beta_{c}": b for c, b in fit.beta.items()}}
    return fit.clusters.agg(F.count(F.lit(1)).alias("clusters"), F.sum("d").alias("events")).select("clusters", "events", *[F.round(F.lit(float(v)), 4).alias(c) for c, v in row.items()])


# --- intensity on a grid of hours
DECAY, HOURS = 0.5, 48


def grid_intensity(spark, sf):
    return P.grid_intensity(I.clicks(spark, sf), "zone", "t", F.col("trust"), DECAY, HOURS).select("zone", "hour", r6("A").alias("A"))


register("grid_intensity", grid_intensity, f"""WITH {I.CLICKS_SQL}, b AS (SELECT min(t // 3600000000) AS low, max(t // 3600000000) + 1 AS high FROM clicks),
g AS (SELECT zone, hour FROM (SELECT DISTINCT zone FROM clicks), (SELECT unnest(range(low, high + 1)) AS hour FROM b))
SELECT g.zone, g.hour, round(coalesce(sum(c.trust * exp(-{DECAY} * (g.hour - c.t / 3600000000.0::DOUBLE))), 0), 6) AS A
FROM g LEFT JOIN clicks c ON c.zone = g.zone AND c.t // 3600000000 BETWEEN g.hour - {HOURS} AND g.hour - 1 GROUP BY g.zone, g.hour""")


# --- counts of the next hours of each series of a cause and a corridor: four models, held out by time
HORIZONS = (1, 2, 3)
COUNT_FEATURES = ["log_count_1h", "log_count_4h", "log_count_24h", "daytime"]
#: Share of an event's offspring and their decay an hour, as given to the self-exciting baseline.
BRANCHING = 0.3


def _series_panel(spark, sf) -> DataFrame:
    """By series and hour: features, counts ahead, the excitation, and whether the hour lies in the first three quarters."""
    events = I.clicks(spark, sf).withColumn("series", F.concat_ws("|", F.col("corridor").cast("string"), "event_cause"))
    panel = M.hourly_panel(events, "series", "t", F.col("trust"), horizons=HORIZONS)
    panel = panel.join(P.grid_intensity(events, "series", "t", F.lit(1.0), DECAY, HOURS), ["series", "hour"])
    span = panel.agg(F.min("hour").alias("low"), F.max("hour").alias("high"))
    panel = panel.crossJoin(F.broadcast(span)).withColumn("cut", F.col("low") + F.floor(0.75 * (F.col("high") - F.col("low"))))
    # an hour is known to train if its longest horizon ends before the cut
    panel = panel.withColumn("early", F.col("hour") + max(HORIZONS) <= F.col("cut")).where(F.col("early") | (F.col("hour") > F.col("cut")))
    daytime = F.cos(2 * 3.141592653589793 * F.pmod("hour", F.lit(24)) / 24)
    return written(panel.withColumns({**{f"log_count_{h}h": F.log1p(f"count_{h}h") for h in (1, 4, 24)}, "daytime": daytime}), "series")


def forecast_grid(spark, sf):
    """By horizon and model the scores of held-out hours: the series' own rate, excitation alone, a Poisson and a
    negative binomial model with a part of its own for zeros."""
    panel = _series_panel(spark, sf)
    rate = panel.where("early").groupBy("series").agg(F.avg("Y_count_1h").alias("rate"))
    panel = panel.join(rate, "series", "left").fillna(0.0, ["rate"])
    said = []
    for h in HORIZONS:
        y = f"Y_count_{h}h"
        rows = panel.where(F.col(y).isNotNull()).withColumn("exposure", F.log(F.greatest(F.col("rate"), F.lit(1e-3)) * h))
        fit = N.fit_hurdle(rows.where("early"), y, COUNT_FEATURES, offset="exposure")
        own, reach = F.col("rate") * h, (1 - F.exp(F.lit(-DECAY * h)))
        excited = (1 - BRANCHING) * own + BRANCHING * F.col("A") * reach
        poisson = fit.without_dispersion()
        models = {"rate": (1 - F.exp(-own), own), "excitation": (1 - F.exp(-excited), excited), "hurdle_poisson": (poisson.any(), poisson.expected()), "hurdle": (fit.any(), fit.expected())}
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p"), e.alias("expected")) for m, (p, e) in models.items()]))
        said.append(rows.where("not early").select(F.lit(h).alias("horizon"), F.col(y).alias("y"), F.lit(fit.alpha).alias("alpha"), each.alias("m")).select("horizon", "y", "alpha", "m.*"))
    scores = N.forecast_scores(reduce(DataFrame.unionByName, said), ["horizon", "model", "alpha"], "p", "expected", "y")
    dispersion = F.when(F.col("model") == "hurdle", F.round("alpha", 4)).alias("alpha")
    return scores.select("horizon", "model", dispersion, "n", *[r6(c).alias(c) for c in ("brier", "log_loss", "auc", "mae", "rmse")])


# --- stacked log durations
def linear_learner(features):
    def learn(rows):
        model = Pipeline(stages=[*L.design(features), LinearRegression(labelCol="label__")]).fit(rows.fillna(0.0, list(features)))
        return lambda others, name: model.transform(others.fillna(0.0, list(features))).withColumnRenamed("prediction", name).drop("features")

    return learn


def mean_learner(column, strength=20.0):
    """Means by a category, drawn towards the overall mean. Categories are a dimension."""

    def learn(rows):
        total = rows.agg(F.avg("label__")).first()[0] or 0.0
        mean = (F.sum("label__") + strength * total) / (F.count("label__") + strength)
        means = rows.groupBy(F.col(column).alias("category__")).agg(mean.alias("mean__"))
        add = lambda others, name: others.join(means, F.col(column).eqNullSafe(F.col("category__")), "left").withColumn(name, F.coalesce("mean__", F.lit(total))).drop("category__", "mean__")
        return add

    return learn


def boosted_learner(features, rounds=5):
    def learn(rows):
        model = B.fit_boosted(rows, F.col("label__"), features, [B.Huber(1.0)], rounds=rounds)
        return lambda others, name: others.withColumn(name, model.predict()[0])

    return learn


def stacked_durations(spark, sf):
    """The weights of a linear, a boosted and two mean models of log durations, and their errors where they were not fitted."""
    rows = I.clicks(spark, sf).select("event_id", "event_cause", "corridor", "duration", F.col("k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday"))
    numeric = ["k", "hour", "weekday"]
    train, held = rows.where(F.col("event_id") % 4 != 0), rows.where(F.col("event_id") % 4 == 0)
    learners = {"linear": linear_learner(numeric), "boosted": boosted_learner(numeric), "cause": mean_learner("event_cause"), "corridor": mean_learner("corridor")}
    stack = K.fit_stack(train, "event_id", F.log1p("duration"), learners)
    said = stack.predict(held.where("duration is not null").withColumn("label__", F.log1p("duration")))
    names = [*learners, "stacked"]
    errors = said.agg(*[F.avg(F.pow(F.col(m) - F.col("label__"), 2)).alias(m) for m in names])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(stack.weights.get(m)).cast("double").alias("weight"), F.lit(stack.errors[m]).alias("fold_error"), F.col(m).alias("held_out_error")) for m in names]))
    return errors.select(each.alias("m")).select("m.model", *[r6(f"m.{c}").alias(c) for c in ("weight", "fold_error", "held_out_error")])


for query in (frailty_effects, frailty_test, forecast_grid, stacked_durations):
    register(query.__name__, query)
