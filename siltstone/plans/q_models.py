"""Queries: fitted models and streams. Models have no SQL; streams are held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import boosting as B
from siltstone.operators import forest as R
from siltstone.operators import incidents as I
from siltstone.operators import learning as L
from siltstone.operators import scenarios as C
from siltstone.operators import spatial as G
from siltstone.operators import survival as V
from siltstone.operators import temporal as M
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6
from siltstone.sources.scratch import written
from siltstone.streaming import jobs as S


def _clicks(spark, sf):
    return I.clicks(spark, sf).withColumn("k", F.col("k").cast("double")).withColumn("hour", F.hour("ts").cast("double"))




def train():
    return F.col("event_id") % 4 != 0


def missingness_model(spark, sf):
    rows = I.shipments(spark, sf).withColumn("month", F.month("start_ts").cast("double"))
    return L.missingness(rows, F.col("end_ts").isNull(), ["price", "month"], ["priority", "event_cause"])


def mahalanobis_drift(spark, sf):
    out = L.mahalanobis(_clicks(spark, sf), ["duration", "k", "hour"], train())
    return out.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), F.count_if("far").alias("far"), r6(F.max("distance")).alias("max_distance"))


def isolation_flags(spark, sf):
    out = L.isolation_scores(_clicks(spark, sf), ["duration", "k", "hour"])
    cut = out.agg(F.percentile("isolation", F.lit(0.95)).alias("cut"))
    return out.crossJoin(F.broadcast(cut)).groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("isolation") > F.col("cut")).alias("flagged"))


def aft_weibull(spark, sf):
    out = L.aft_weibull(_clicks(spark, sf).withColumn("event", (~F.col("is_censored")).cast("int")), "duration", "event", ["k", "hour"])
    return out.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p50")).alias("p50"))


def lognormal_aft(spark, sf):
    out, sigma = L.lognormal_aft(_clicks(spark, sf).where(~F.col("is_censored")), "duration", ["k", "hour"])
    return out.groupBy("event_cause").agg(r6(F.avg("log_mean")).alias("log_mean"), F.first(F.round(F.lit(sigma), 6)).alias("sigma"))


def pca_burden(spark, sf):
    out = L.first_component(I.junctions(I.clicks(spark, sf)).withColumn("n", F.col("n").cast("double")), ["n", "mean_duration", "burden", "closure_rate"], "burden")
    return out.select("junction", r6("pc1").alias("pc1"))


def _panel(spark, sf):
    p = M.hourly_panel(I.clicks(spark, sf), "zone", "t", F.col("trust"))
    return p.where(F.col("Y_count_3h").isNotNull()).withColumn("event_id", F.col("hour")).withColumns({c: F.col(c).cast("double") for c in ("count_1h", "count_4h", "count_24h")})


FEATURES = ["count_1h", "count_4h", "count_24h", "burden_4h"]


def boosted_zone_risk(spark, sf):
    p = L.boosted_classifier(_panel(spark, sf), F.col("Y_count_3h") >= 9, train(), FEATURES)
    c = L.calibrate(p, "p", F.col("Y_count_3h") >= 9, F.col("event_id") % 4 == 1)
    return c.where(~train()).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("p"), r6(F.avg("calibrated")).alias("calibrated"))


def poisson_zone_counts(spark, sf):
    out = L.poisson_counts(_panel(spark, sf), "Y_count_3h", train(), FEATURES)
    return out.where(~train()).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("expected")).alias("expected"), r6(F.avg("Y_count_3h")).alias("actual"))


DURATION_FEATURES = ["k", "hour", "weekday", "event_cause__mean", "corridor__mean"]


def _boosted_durations(spark, sf, losses):
    """Events with predictions of log durations by trees fitted on the train rows, one for each loss, and the model."""
    rows = _clicks(spark, sf).withColumn("weekday", F.weekday("ts").cast("double"))
    y = F.log1p("duration")
    for c in ("event_cause", "corridor"):
        rows = B.target_means(rows, train(), c, y)
    model = B.fit_boosted(rows.where(train()), y, DURATION_FEATURES, losses, rounds=10)
    return rows.withColumn("said", model.predict()), model


def boosted_duration_quantiles(spark, sf):
    out, _ = _boosted_durations(spark, sf, [B.Pinball(0.5), B.Pinball(0.8), B.Pinball(0.95), B.Huber(1.0)])
    # quantiles in order, as minutes
    quantiles = F.transform(F.array_sort(F.slice("said", 1, 3)), F.expm1)
    held = out.where(~train()).select("event_cause", "duration", quantiles.alias("q"), F.expm1(F.col("said")[3]).alias("huber"))
    covered = [r6(F.avg((F.col("duration") <= F.col("q")[i]).cast("double"))).alias(f"covered_p{p}") for i, p in enumerate((50, 80, 95))]
    middle = [r6(F.avg(F.col("q")[i])).alias(f"p{p}") for i, p in enumerate((50, 80, 95))]
    return held.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), *covered, *middle, r6(F.avg("huber")).alias("huber"))


def _parts(spark, sf):
    out, model = _boosted_durations(spark, sf, [B.Huber(1.0)])
    mean = model.start[0] + sum(B.mean_margin(t) for t in model.trees[0])
    parts = F.arrays_zip(F.array(*[F.lit(f) for f in model.features]).alias("feature"), F.col("part").alias("part"))
    return out.where(~train()).withColumn("part", model.attribute(0)).select("event_id", F.col("said")[0].alias("prediction"), F.lit(mean).alias("mean"), parts.alias("parts"))


def duration_drivers(spark, sf):
    """Of each held-out event the three features that move its predicted log duration most, and by how much."""
    ordered = F.array_sort("parts", lambda a, b: F.when(F.abs(a["part"]) > F.abs(b["part"]), -1).when(F.abs(a["part"]) < F.abs(b["part"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    rows = _parts(spark, sf).withColumn("top", F.slice(ordered, 1, 3))
    names = [F.col("top")[i]["feature"].alias(f"driver{i + 1}") for i in range(3)]
    sizes = [r6(F.col("top")[i]["part"]).alias(f"part{i + 1}") for i in range(3)]
    return rows.select("event_id", r6("prediction").alias("prediction"), r6("mean").alias("mean"), *names, *sizes)


def driver_summary(spark, sf):
    """Mean size, mean and largest size of each feature's part in the held-out predictions."""
    each = _parts(spark, sf).select(F.inline("parts"))
    return each.groupBy("feature").agg(r6(F.avg(F.abs("part"))).alias("mean_size"), r6(F.avg("part")).alias("mean_part"), r6(F.max(F.abs("part"))).alias("largest"))


FOREST_FEATURES = ["price", "month", "urgent", "event_cause__mean", "corridor__mean"]


def _forest(spark, sf):
    """Shipments with T and event, and a survival forest fitted on three in four of them."""
    rows = I.shipments(spark, sf).where("duration >= 0").withColumns({"T": F.col("duration"), "event": (~F.col("is_censored")).cast("int"), "month": F.month("start_ts").cast("double"), "urgent": F.col("priority").isin("1-URGENT", "2-HIGH").cast("double")})
    # orders and their lines are joined once, not for every pass of the means, the forest and what is told of it
    rows = written(rows.select("event_id", "T", "event", "duration", "event_cause", "corridor", "price", "month", "urgent"), "shipments")
    for c in ("event_cause", "corridor"):
        rows = B.target_means(rows, train(), c, F.log1p("duration"))
    return rows, R.fit_forest(rows.where(train()), "event_id", "T", F.col("event") == 1, FOREST_FEATURES, trees=20)


def survival_forest(spark, sf):
    """Held-out shipments by cause: their mean risk, median time and how far apart the riskiest and safest tenth end."""
    rows, forest = _forest(spark, sf)
    out = rows.where(~train()).withColumn("said", forest.predict())
    return out.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("said.risk")).alias("risk"), r6(F.avg("said.p50")).alias("p50"), r6(F.corr("said.risk", "T")).alias("corr_with_time"))


def survival_forest_importance(spark, sf):
    """The held-out concordance of the forest and of a proportional-hazards fit, and what each feature adds to the forest's."""
    rows, forest = _forest(spark, sf)
    held = written(rows.where(~train()).select("event_id", "T", "event", *FOREST_FEATURES), "held")
    score = lambda x: float(V.concordance(x, "risk").first()["c_index"] or 0.5)
    beta = C.cox_fit(rows.where(train()).withColumn("weight", F.lit(1.0)).withColumn("price", F.col("price") / 1e5), ["price", "urgent"])
    cox = score(held.withColumn("risk", F.col("price") / 1e5 * beta["price"] + F.col("urgent") * beta["urgent"]))
    whole = score(held.withColumn("risk", forest.predict()["risk"]))
    found = [("forest", whole), ("proportional hazards", cox), *R.permutation_importance(held, forest, "event_id", score)]
    return spark.createDataFrame(found, "name string, value double").select("name", r6("value").alias("value"))


def prototype_clusters(spark, sf):
    out = L.prototypes(I.junctions(I.clicks(spark, sf)).withColumn("n", F.col("n").cast("double")), "junction", ["n", "mean_duration", "burden", "closure_rate"], 10)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("is_medoid"), F.col("junction"))).alias("medoid"), r6(F.avg("burden")).alias("burden"))


def rank_stability(spark, sf):
    out = L.rank_stability(I.junctions(I.clicks(spark, sf)), "junction", "burden")
    return out.select("junction", r6("p_top").alias("p_top"), r6("mean_rank").alias("mean_rank"))


def permutation_hotspots(spark, sf):
    j = I.junctions(I.clicks(spark, sf))
    out = L.permutation_p(j, G.nearest_neighbours(j, "junction", 6).select("junction", "neighbour"), "junction", "burden")
    return out.select("junction", r6("p_high").alias("p_high"), (F.col("p_high") < 0.05).alias("significant"))


for query in (missingness_model, isolation_flags, aft_weibull, pca_burden, boosted_zone_risk, poisson_zone_counts, boosted_duration_quantiles, duration_drivers, driver_summary, survival_forest, survival_forest_importance, prototype_clusters, rank_stability, permutation_hotspots):
    register(query.__name__, query)


ROWS_SQL = f"""{I.CLICKS_SQL}, x AS (SELECT event_id, event_cause, is_censored, duration AS a, CAST(k AS DOUBLE) AS b, CAST(hour(ts) AS DOUBLE) AS c FROM clicks)"""

# the inverse of a symmetric matrix of three columns by its cofactors
register("mahalanobis_drift", mahalanobis_drift, f"""WITH {ROWS_SQL},
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_samp(a, a) + 1e-6 AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, b) + 1e-6 AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) + 1e-6 AS cc FROM x WHERE event_id % 4 <> 0),
i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
d AS (SELECT event_id, event_cause, sqrt(greatest(0, (a - ma) ** 2 * (bb * cc - bc * bc) + (b - mb) ** 2 * (aa * cc - ac * ac) + (c - mc) ** 2 * (aa * bb - ab * ab)
  + 2 * (a - ma) * (b - mb) * (ac * bc - ab * cc) + 2 * (a - ma) * (c - mc) * (ab * bc - ac * bb) + 2 * (b - mb) * (c - mc) * (ab * ac - aa * bc)) / det) AS distance FROM x, i),
q AS (SELECT quantile_cont(distance, 0.95) AS cut FROM d WHERE event_id % 4 <> 0)
SELECT event_cause, count(*) AS n, count(*) FILTER (distance > cut) AS far, round(max(distance), 6) AS max_distance FROM d, q GROUP BY event_cause""")
# least squares with two columns by their covariances
register("lognormal_aft", lognormal_aft, f"""WITH {ROWS_SQL}, y AS (SELECT *, ln(a) AS y FROM x WHERE NOT is_censored AND a > 0),
m AS (SELECT avg(y) AS my, avg(b) AS mb, avg(c) AS mc, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(b, y) AS yb, covar_pop(c, y) AS yc FROM y),
k AS (SELECT *, (yb * cc - yc * bc) / (bb * cc - bc * bc) AS kb, (yc * bb - yb * bc) / (bb * cc - bc * bc) AS kc FROM m),
p AS (SELECT event_cause, y, my + kb * (b - mb) + kc * (c - mc) AS log_mean FROM y, k), e AS (SELECT round(sqrt(avg((y - log_mean) ** 2)), 6) AS sigma FROM p)
SELECT event_cause, round(avg(log_mean), 6) AS log_mean, any_value(sigma) AS sigma FROM p, e GROUP BY event_cause""")


# --- streams: a closed window is emitted once; the watermark never closes the last ones, which batch SQL leaves out too
def _closed(column: str, size_us: int) -> str:
    return f"WHERE start_us + {size_us} <= (SELECT epoch_us(max(ts)) - 86400000000 FROM events)"


def stream_tumbling(spark, sf):
    out = S.run_to_table(S.tumbling(S.events_in_order(spark, sf)), "tumbling")
    return out.select("start_us", "event_type", "n", r6("mean").alias("mean"))


register("stream_tumbling", stream_tumbling, f"""
WITH w AS (SELECT epoch_us(date_trunc('week', ts)) AS start_us, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL) SELECT start_us, event_type, n, round(mean, 6) AS mean FROM w {_closed("start_us", 7 * 86400000000)}""")


def stream_sliding(spark, sf):
    return S.run_to_table(S.sliding(S.events_in_order(spark, sf)), "sliding")


register("stream_sliding", stream_sliding, f"""
WITH w AS (SELECT (epoch_us(ts) // 3600000000 - s) * 3600000000 AS start_us, user_id % 5 AS zone, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS s) GROUP BY ALL) SELECT * FROM w {_closed("start_us", 4 * 3600000000)}""")


def stream_sessions(spark, sf):
    return S.run_to_table(S.sessions(S.events_in_order(spark, sf)), "sessions")


register("stream_sessions", stream_sessions, """
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(t) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, session HAVING max(t) + 21600000000 <= (SELECT epoch_us(max(ts)) - 86400000000 FROM events)""")


def stream_running_posterior(spark, sf):
    out = S.run_to_table(S.running_posterior(S.events_in_order(spark, sf)), "posterior", "update")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "mean", "variance", "ewma", "alerts"), "batch").alias("s"))
    return last.select("event_type", "s.n", r6("s.mean").alias("mean"), r6("s.variance").alias("variance"), r6("s.ewma").alias("ewma"), "s.alerts")


register("stream_running_posterior", stream_running_posterior, """
WITH x AS (SELECT event_type, ln(1 + value) AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS size, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS age, sum(ln(1 + value) - 2.02) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), p AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING)) AS ph FROM x)
SELECT event_type, count(*) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(sum(CASE WHEN age = size - 1 THEN pow(0.8, age) ELSE 0.2 * pow(0.8, age) END * x), 6) AS ewma, count(*) FILTER (ph > 5) AS alerts FROM p GROUP BY event_type""")
