"""Queries: point-in-time features, sequences, point processes, posteriors, calibration and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import bayes as B
from siltstone.operators import crosszone as Z
from siltstone.operators import incidents as I
from siltstone.operators import pointprocess as P
from siltstone.operators import temporal as M
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6

HIGH = 20.0  # minutes above which a click counts as high impact


def asof_burden(spark, sf):
    out = M.asof_state(I.clicks(spark, sf), ["corridor"], "t", F.col("trust"))
    return out.select("corridor", "day", "asof_count", r6("asof_total").alias("asof_total"), r6("asof_decayed").alias("asof_decayed"))


register("asof_burden", asof_burden, f"""
WITH {I.CLICKS_SQL}, d AS (SELECT corridor, t // 86400000000 AS day, count(*) AS n, sum(trust) AS total FROM clicks GROUP BY ALL),
g AS (SELECT corridor, unnest(range((SELECT min(day) FROM d), (SELECT max(day) FROM d) + 1)) AS day FROM (SELECT DISTINCT corridor FROM d))
SELECT g.corridor, g.day, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS asof_count, round(coalesce(sum(d.total), 0), 6) AS asof_total, round(coalesce(sum(d.total * exp(-0.05 * (g.day - d.day))), 0), 6) AS asof_decayed
FROM g LEFT JOIN d ON d.corridor = g.corridor AND d.day < g.day - 1 GROUP BY g.corridor, g.day""")


def lookback_counts(spark, sf):
    c = I.clicks(spark, sf).select("zone", "event_cause", "t", "trust")
    out = M.lookback(c, ["zone"], "t", (1, 4, 24), F.col("trust"))
    return out.groupBy("zone", "event_cause").agg(*[F.sum(f"count_{h}h").alias(f"count_{h}h") for h in (1, 4, 24)], *[r6(F.sum(f"mark_{h}h")).alias(f"mark_{h}h") for h in (1, 4, 24)])


register("lookback_counts", lookback_counts, f"""
WITH {I.CLICKS_SQL}, w AS (SELECT zone, event_cause,
  {", ".join(f"count(*) OVER w{h} AS c{h}, coalesce(sum(trust) OVER w{h}, 0) AS m{h}" for h in (1, 4, 24))} FROM clicks
  WINDOW {", ".join(f"w{h} AS (PARTITION BY zone ORDER BY t RANGE BETWEEN {h * 3600000000} PRECEDING AND 1 PRECEDING)" for h in (1, 4, 24))})
SELECT zone, event_cause, {", ".join(f"CAST(sum(c{h}) AS BIGINT) AS count_{h}h, round(sum(m{h}), 6) AS mark_{h}h" for h in (1, 4, 24))} FROM w GROUP BY ALL""")

PANEL_SQL = f"""{I.CLICKS_SQL},
s AS (SELECT zone, t // 3600000000 AS hour, count(*) AS n, sum(trust) AS m FROM clicks GROUP BY ALL), b AS (SELECT min(hour) AS low, max(hour) + 1 AS high FROM s),
g AS (SELECT zone, high, unnest(range(low, high + 1)) AS hour FROM (SELECT DISTINCT zone FROM s), b),
f AS (SELECT g.zone, g.hour, g.high, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM g LEFT JOIN s ON s.zone = g.zone AND s.hour = g.hour),
panel AS (SELECT zone, hour, n, m, {", ".join(f"coalesce(sum(n) OVER b{h}, 0) AS count_{h}h, coalesce(sum(m) OVER b{h}, 0) AS burden_{h}h" for h in (1, 4, 24))},
  {", ".join(f"CASE WHEN hour + {h} <= high THEN sum(n) OVER a{h} END AS Y_count_{h}h" for h in (3, 6, 9))} FROM f
  WINDOW {", ".join(f"b{h} AS (PARTITION BY zone ORDER BY hour ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)" for h in (1, 4, 24))}, {", ".join(f"a{h} AS (PARTITION BY zone ORDER BY hour ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in (3, 6, 9))})"""


def zone_hour_panel(spark, sf):
    p = M.hourly_panel(I.clicks(spark, sf), "zone", "t", F.col("trust"))
    return p.select("zone", "hour", *[f"count_{h}h" for h in (1, 4, 24)], *[r6(f"burden_{h}h").alias(f"burden_{h}h") for h in (1, 4, 24)], *[f"Y_count_{h}h" for h in (3, 6, 9)], *[f"Y_bin_{h}h" for h in (3, 6, 9)])


register("zone_hour_panel", zone_hour_panel, f"""WITH {PANEL_SQL}
SELECT zone, hour, {", ".join(f"CAST(count_{h}h AS BIGINT) AS count_{h}h, round(burden_{h}h, 6) AS burden_{h}h" for h in (1, 4, 24))}, {", ".join(f"CAST(Y_count_{h}h AS BIGINT) AS Y_count_{h}h, CAST(Y_count_{h}h > 0 AS INTEGER) AS Y_bin_{h}h" for h in (3, 6, 9))} FROM panel""")


def horizon_pivot_persistence(spark, sf):
    p = M.hourly_panel(I.clicks(spark, sf), "zone", "t", F.col("trust"))
    long = p.select("zone", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"Y_count_{h}h").cast("double").alias("y")) for h in (3, 6, 9)])).alias("s")).select("zone", "s.*")
    wide = long.groupBy("zone").pivot("horizon", [3, 6, 9]).agg(F.avg("y"))
    a, b, c = (F.coalesce(F.col(str(h)), F.lit(0.0)) for h in (3, 6, 9))
    return wide.select("zone", r6("3").alias("y_3h"), r6("6").alias("y_6h"), r6("9").alias("y_9h"), r6((a + b + c) / 3).alias("mean"), r6((c - a) / 6).alias("slope"), r6(F.greatest(a, b, c)).alias("peak"))


register("horizon_pivot_persistence", horizon_pivot_persistence, f"""WITH {PANEL_SQL}, w AS (SELECT zone, avg(Y_count_3h) AS a, avg(Y_count_6h) AS b, avg(Y_count_9h) AS c FROM panel GROUP BY zone)
SELECT zone, round(a, 6) AS y_3h, round(b, 6) AS y_6h, round(c, 6) AS y_9h, round((a + b + c) / 3, 6) AS mean, round((c - a) / 6, 6) AS slope, round(greatest(a, b, c), 6) AS peak FROM w""")


def asof_burstiness(spark, sf):
    out = M.burstiness(I.clicks(spark, sf), ["corridor"], "t")
    return out.select("corridor", "n", r6("burstiness").alias("burstiness"))


register("asof_burstiness", asof_burstiness, f"""
WITH {I.CLICKS_SQL}, l AS (SELECT *, max(t) OVER (PARTITION BY corridor) AS last_t FROM clicks), r AS (SELECT * FROM l WHERE t >= last_t - 86400000000),
g AS (SELECT corridor, (t - lag(t) OVER (PARTITION BY corridor ORDER BY t, event_id)) / 3600000000.0::DOUBLE AS gap FROM r)
SELECT corridor, count(*) AS n, round(CASE WHEN count(gap) >= 2 THEN stddev_samp(gap) / (avg(gap) + 1e-6) ELSE 0 END, 6) AS burstiness FROM g GROUP BY corridor""")


def page_hinkley_alerts(spark, sf):
    rows = I.clicks(spark, sf).withColumn("x", F.log1p("duration"))
    rows = rows.join(rows.groupBy("zone").agg(F.avg("x").alias("mean")), "zone")
    out = M.page_hinkley(rows, ["zone"], ["t", "event_id"], "x", "mean")
    return out.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if("alert").alias("alerts"), r6(F.max("ph")).alias("max_ph"))


register("page_hinkley_alerts", page_hinkley_alerts, f"""
WITH {I.CLICKS_SQL}, m AS (SELECT *, ln(1 + duration) - avg(ln(1 + duration)) OVER (PARTITION BY zone) - 0.02 AS d FROM clicks),
c AS (SELECT *, sum(d) OVER w AS s FROM m WINDOW w AS (PARTITION BY zone ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT zone, s - least(0, min(s) OVER w) AS ph FROM c WINDOW w AS (PARTITION BY zone ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT zone, count(*) AS n, count(*) FILTER (ph > 5) AS alerts, round(max(ph), 6) AS max_ph FROM p GROUP BY zone""")


def ewma_residual(spark, sf):
    out = M.ewma(I.clicks(spark, sf), ["junction"], ["t", "event_id"], "duration")
    return out.select("junction", "n", r6("ewma").alias("ewma"))


register("ewma_residual", ewma_residual, f"""
WITH {I.CLICKS_SQL}, a AS (SELECT junction, duration, row_number() OVER (PARTITION BY junction ORDER BY t DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY junction) AS size FROM clicks)
SELECT junction, count(*) AS n, round(sum(CASE WHEN age = size - 1 THEN pow(0.8, age) ELSE 0.2 * pow(0.8, age) END * duration), 6) AS ewma FROM a GROUP BY junction""")


def weekly_drift_score(spark, sf):
    from pyspark.sql import Window as W

    rows = I.clicks(spark, sf).withColumn("x", F.log1p("duration")).withColumn("week", F.concat(F.extract(F.lit("YEAROFWEEK"), "ts"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
    weeks = rows.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    order = W.orderBy("week")
    return weeks.select("week", "n", r6("mean").alias("mean"), r6(F.abs(F.col("mean") - F.lag("mean").over(order)) / F.greatest(F.lag("sd").over(order), F.lit(1e-6))).alias("drift"))


register("weekly_drift_score", weekly_drift_score, f"""
WITH {I.CLICKS_SQL}, w AS (SELECT CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, count(*) AS n, avg(ln(1 + duration)) AS mean, stddev_samp(ln(1 + duration)) AS sd FROM clicks GROUP BY 1)
SELECT week, n, round(mean, 6) AS mean, round(abs(mean - lag(mean) OVER (ORDER BY week)) / greatest(lag(sd) OVER (ORDER BY week), 1e-6), 6) AS drift FROM w""")


def psi_bins(spark, sf):
    c = I.early(I.clicks(spark, sf), 0.6)
    out = B.population_stability(c.where("early"), c.where("not early"), "duration")
    return out.select("bins", r6("psi").alias("psi"))


register("psi_bins", psi_bins, f"""
WITH {I.CLICKS_SQL}, base AS (SELECT duration AS x FROM clicks WHERE {I.early_sql(0.6)}), new AS (SELECT duration AS x FROM clicks WHERE NOT {I.early_sql(0.6)}),
e AS (SELECT list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM base),
p AS (SELECT greatest(1, len(list_filter(e, lambda v: v < x))) AS bin, count(*) / (SELECT count(*) FROM base)::DOUBLE AS p FROM base, e GROUP BY 1),
q AS (SELECT greatest(1, len(list_filter(e, lambda v: v < x))) AS bin, count(*) / (SELECT count(*) FROM new)::DOUBLE AS q FROM new, e WHERE x >= list_min(e) - 1e-9 AND x <= list_max(e) + 1e-9 GROUP BY 1)
SELECT count(*) AS bins, round(sum((greatest(coalesce(q, 0), 1e-6) - greatest(coalesce(p, 0), 1e-6)) * ln(greatest(coalesce(q, 0), 1e-6) / greatest(coalesce(p, 0), 1e-6))), 6) AS psi FROM p FULL JOIN q USING (bin)""")


def autocorrelation_half_life(spark, sf):
    days = I.clicks(spark, sf).groupBy(F.floor(F.col("t") / M.DAY).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return M.half_life_days(days, "day", "n")


register("autocorrelation_half_life", autocorrelation_half_life, f"""
WITH {I.CLICKS_SQL}, d AS (SELECT row_number() OVER (ORDER BY t // 86400000000) AS i, CAST(count(*) AS DOUBLE) AS x FROM clicks GROUP BY t // 86400000000),
c AS (SELECT lag, corr(a.x, b.x) AS r FROM (SELECT unnest(range(1, 61)) AS lag) l, d a JOIN d b ON b.i = a.i + lag GROUP BY lag)
SELECT coalesce(greatest(1, least(180, min(lag) FILTER (r < 0.5))), 30) AS half_life FROM c WHERE NOT isnan(r)""")

# --- point process
MU, ALPHA, BETA = 0.4, 0.3, 1.2


def _kernel(spark, sf):
    return P.kernel_sum(I.clicks(spark, sf), "zone", "t", F.col("trust"), BETA)


KERNEL_SQL = f"""{I.CLICKS_SQL}, hours AS (SELECT *, t / 3600000000.0::DOUBLE AS h FROM clicks),
kernel AS (SELECT a.event_id, a.zone, a.h, a.trust AS m, coalesce(sum(b.trust * exp(-{BETA} * (a.h - b.h))), 0) AS A FROM hours a LEFT JOIN hours b ON a.zone = b.zone AND b.t < a.t AND a.h - b.h < 26 GROUP BY a.event_id, a.zone, a.h, a.trust)"""


def hawkes_intensity_given_params(spark, sf):
    k = _kernel(spark, sf)
    lam = MU + ALPHA * F.col("A")
    return k.groupBy("zone", "event_cause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(lam)).alias("mean_intensity"), r6(F.max(lam)).alias("max_intensity"), r6(F.avg(F.log(1 + F.greatest(lam - MU, F.lit(0.0)) / (MU + 0.01)))).alias("fragility"))


register("hawkes_intensity_given_params", hawkes_intensity_given_params, f"""WITH {KERNEL_SQL}, l AS (SELECT k.zone, c.event_cause, {MU} + {ALPHA} * A AS lam FROM kernel k JOIN clicks c ON c.event_id = k.event_id)
SELECT zone, event_cause, count(*) AS n, round(avg(lam), 6) AS mean_intensity, round(max(lam), 6) AS max_intensity, round(avg(ln(1 + greatest(lam - {MU}, 0) / ({MU} + 0.01))), 6) AS fragility FROM l GROUP BY ALL""")


def hawkes_lr_given_params(spark, sf):
    out = P.hawkes_likelihood(_kernel(spark, sf), "zone", MU, ALPHA, BETA)
    return out.select("zone", "n", *[F.round(c, 4).alias(c) for c in ("span", "ll_hawkes", "ll_poisson", "lr", "p_value")])


register("hawkes_lr_given_params", hawkes_lr_given_params, f"""WITH {KERNEL_SQL}, b AS (SELECT min(h) AS lo, max(h) AS hi FROM kernel),
s AS (SELECT zone, count(*) AS n, any_value(hi - lo) AS span, sum(ln({MU} + {ALPHA} * A)) - {MU} * any_value(hi - lo) - {ALPHA} / {BETA} * sum(m * (1 - exp(-{BETA} * (hi - h)))) AS llh, count(*) * ln(count(*) / any_value(hi - lo)) - count(*) AS llp FROM kernel, b GROUP BY zone)
SELECT zone, n, round(span, 4) AS span, round(llh, 4) AS ll_hawkes, round(llp, 4) AS ll_poisson, round(greatest(0, 2 * (llh - llp)), 4) AS lr, round(exp(-greatest(0, 2 * (llh - llp)) / 2), 4) AS p_value FROM s""")


def time_rescaling_test(spark, sf):
    out = P.rescaling_test(_kernel(spark, sf), "zone", MU, ALPHA, BETA)
    return out.select("zone", "n", r6("D").alias("D"))


register("time_rescaling_test", time_rescaling_test, f"""WITH {KERNEL_SQL},
g AS (SELECT zone, event_id, h - lag(h) OVER o AS dt, lag(A + m) OVER o AS before FROM kernel WINDOW o AS (PARTITION BY zone ORDER BY h, event_id)),
r AS (SELECT zone, event_id, {MU} * dt + {ALPHA} / {BETA} * before * (1 - exp(-{BETA} * dt)) AS gap FROM g WHERE dt IS NOT NULL),
k AS (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY gap, event_id) AS i, count(*) OVER (PARTITION BY zone) AS n, 1 - exp(-gap) AS cdf FROM r)
SELECT zone, any_value(n) AS n, round(max(greatest(i / n::DOUBLE - cdf, cdf - (i - 1) / n::DOUBLE)), 6) AS D FROM k GROUP BY zone""")


def cross_zone_excitation(spark, sf):
    c = I.clicks(spark, sf)
    edges = spark.createDataFrame([(z, (z + 1) % 5) for z in range(5)], "source_zone long, receiver_zone long")
    out = P.excitation(c, c, edges, "t", F.col("trust"), 3.0)
    return c.select("event_id", "zone").join(out, "event_id").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("excitation")).alias("mean"), r6(F.max("excitation")).alias("max"))


register("cross_zone_excitation", cross_zone_excitation, f"""
WITH {I.CLICKS_SQL}, s AS (SELECT zone, t // 3600000000 AS hour, sum(trust) AS m FROM clicks GROUP BY ALL),
x AS (SELECT c.event_id, c.zone, coalesce(sum(s.m * exp(-3.0 * (c.t // 3600000000 - s.hour - 1))), 0) AS e FROM clicks c LEFT JOIN s ON c.zone = (s.zone + 1) % 5 AND c.t // 3600000000 - s.hour BETWEEN 1 AND 11 GROUP BY c.event_id, c.zone)
SELECT zone, count(*) AS n, round(avg(e), 6) AS mean, round(max(e), 6) AS max FROM x GROUP BY zone""")


def hawkes_fit(spark, sf):
    out = P.fit_hawkes(I.clicks(spark, sf), "zone", "t")
    branching = F.col("alpha") / F.greatest("beta", F.lit(1e-6))
    return out.select("key", "n", r6("mu").alias("mu"), r6("alpha").alias("alpha"), r6("beta").alias("beta"), r6("ll").alias("ll"), X.cases([(branching >= 0.7, "critical"), (branching >= 0.3, "cascading")], "stable").alias("class"))


register("hawkes_fit", hawkes_fit)


def cross_zone_fit(spark, sf):
    """Excitation of each zone by itself and by its two neighbours in the ring of zones, fitted jointly."""
    zones = [r[0] for r in I.clicks(spark, sf).select("zone").distinct().orderBy("zone").collect()]
    ring = {z: sorted({zones[i - 1], zones[(i + 1) % len(zones)]} - {z}) for i, z in enumerate(zones)}
    fit = Z.fit_cross_zone(I.clicks(spark, sf), ring, "zone", "t", F.col("trust"), betas=(0.05, 0.5, 5.0))
    return fit.select("source_zone", "receiver_zone", *[r6(c).alias(c) for c in ("alpha", "se", "ci_low", "ci_high", "branching", "beta", "half_life_hours", "lr", "p_value")])


register("cross_zone_fit", cross_zone_fit)

# --- posteriors, calibration, metrics


def hierarchical_posterior(spark, sf):
    c = I.early(I.clicks(spark, sf), 0.75).withColumn("area", F.col("junction") % 97)
    x = F.log1p("duration")
    last = c.agg(F.max("t").alias("last"))
    feedback = c.where("not early").crossJoin(F.broadcast(last))
    w = B.forgetting(F.floor((F.col("last") - F.col("t")) / M.DAY))
    out = B.normal_posterior(c.where("early"), ["event_cause", "area"], feedback, x, w, ["event_cause", "area"])
    return out.select("event_cause", "area", "level", *[r6(v).alias(v) for v in ("n_eff", "prior_mean", "posterior_mean", "posterior_variance", "prior_influence")])


register("hierarchical_posterior", hierarchical_posterior, f"""
WITH {I.CLICKS_SQL}, x AS (SELECT *, junction % 97 AS area, ln(1 + duration) AS x, exp(-ln(2) / 30 * greatest(((SELECT max(t) FROM clicks) - t) // 86400000000, 0)) AS w FROM clicks),
p AS (SELECT * FROM x WHERE {I.early_sql(0.75)}), f AS (SELECT event_cause, area, sum(w) ** 2 / sum(w * w) AS n_eff, sum(w * x) / sum(w) AS fm FROM x WHERE NOT {I.early_sql(0.75)} GROUP BY ALL),
s AS (SELECT event_cause, area, count(*) AS n, avg(x) AS m, greatest(1e-6, sum(x * x) / count(*) - avg(x) ** 2) AS v FROM p GROUP BY ALL), c AS (SELECT event_cause, count(*) AS n, avg(x) AS m, greatest(1e-6, sum(x * x) / count(*) - avg(x) ** 2) AS v FROM p GROUP BY ALL),
j AS (SELECT f.*, CASE WHEN s.n >= 3 THEN 'stratum' ELSE 'cause' END AS level, CASE WHEN s.n >= 3 THEN s.m ELSE c.m END AS pm, CASE WHEN s.n >= 3 THEN s.v ELSE c.v END AS pv FROM f LEFT JOIN s USING (event_cause, area) JOIN c USING (event_cause))
SELECT event_cause, area, level, round(n_eff, 6) AS n_eff, round(pm, 6) AS prior_mean, round(CASE WHEN n_eff >= 1 THEN (pm / pv + n_eff * fm / pv) / (1 / pv + n_eff / pv) ELSE pm END, 6) AS posterior_mean,
  round(CASE WHEN n_eff >= 1 THEN 1 / (1 / pv + n_eff / pv) ELSE pv END, 6) AS posterior_variance, round(greatest(0, least(1, CASE WHEN n_eff >= 1 THEN 1 / (1 + n_eff) ELSE 1 END)), 6) AS prior_influence FROM j""")


def prequential_posterior(spark, sf):
    c = I.clicks(spark, sf).withColumn("x", F.log1p("duration"))
    out = B.prequential(c, ["event_cause", "corridor"], ["t", "event_id"], "x", 2.0, 0.8)
    sd = F.sqrt("predictive_variance")
    kl = X.gaussian_kl(F.col("predictive_mean"), sd, F.lit(2.0), F.lit(1.0))
    return out.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("covered").cast("double"))).alias("coverage"), F.round(F.avg(X.gaussian_crps(F.col("x"), F.col("predictive_mean"), sd)), 5).alias("crps"), r6(F.avg(X.gaussian_entropy(sd))).alias("entropy"), r6(F.avg(kl)).alias("kl"))


#: The same rational approximation of the normal distribution function.
CRPS_SQL = """s * (z * (2 * CASE WHEN z >= 0 THEN 1 - tail ELSE tail END - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))"""
register("prequential_posterior", prequential_posterior, f"""
WITH {I.CLICKS_SQL}, x AS (SELECT *, ln(1 + duration) AS x FROM clicks),
b AS (SELECT *, count(*) OVER w AS nb, coalesce(sum(x) OVER w, 0) AS tb FROM x WINDOW w AS (PARTITION BY event_cause, corridor ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (2.0 + tb) / (1 + nb) AS pm, sqrt(0.8 * (1 + 1.0::DOUBLE / (1 + nb))) AS s FROM b), q AS (SELECT *, (x - pm) / s AS z, 1 / (1 + abs((x - pm) / s) / sqrt(2) * 0.5) AS u FROM p),
r AS (SELECT *, u * exp(-z * z / 2 + ((((((((0.17087277 * u - 0.82215223) * u + 1.48851587) * u - 1.13520398) * u + 0.27886807) * u - 0.18628806) * u + 0.09678418) * u + 0.37409196) * u + 1.00002368) * u - 1.26551223) / 2 AS tail FROM q)
SELECT event_cause, count(*) AS n, round(avg(CASE WHEN abs(x - pm) <= 1.959964 * s THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg({CRPS_SQL}), 5) AS crps, round(avg(0.5 * ln(2 * pi() * exp(1)) + ln(s)), 6) AS entropy,
  round(avg(greatest(0, least(1e6, ln(1 / s) + (s * s + (pm - 2) ** 2) / 2 - 0.5))), 6) AS kl FROM r GROUP BY event_cause""")


def _forecasts(spark, sf):
    rows = B.prequential(I.clicks(spark, sf).withColumn("x", F.log1p("duration")), ["event_cause", "corridor"], ["t", "event_id"], "x", 2.0, 0.8)
    return rows.withColumn("predictive_sd", F.sqrt("predictive_variance")).withColumn("posterior_sd", F.sqrt(0.8 * (1 / (1 + F.col("n_before"))))).withColumn("width", 3.919928 * F.col("predictive_sd"))


FORECASTS_SQL = f"""{I.CLICKS_SQL}, x AS (SELECT *, ln(1 + duration) AS x FROM clicks),
b AS (SELECT *, count(*) OVER w AS nb, coalesce(sum(x) OVER w, 0) AS tb FROM x WINDOW w AS (PARTITION BY event_cause, corridor ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (2.0 + tb) / (1 + nb) AS pm, sqrt(0.8 * (1 + 1.0::DOUBLE / (1 + nb))) AS s, sqrt(0.8 * (1.0::DOUBLE / (1 + nb))) AS posterior FROM b),
f AS (SELECT *, 3.919928 * s AS width, abs(x - pm) <= 1.959964 * s AS covered, (x - pm) / s AS z, 1 / (1 + abs((x - pm) / s) / sqrt(2) * 0.5) AS u FROM p)"""


def sharpness_curve(spark, sf):
    """Coverage of the forecasts' intervals by bins of their width."""
    return B.sharpness_curve(_forecasts(spark, sf), "width", "covered").select(F.col("bin").cast("long").alias("bin"), "n", r6("interval_width").alias("interval_width"), r6("empirical_coverage").alias("empirical_coverage"))


register("sharpness_curve", sharpness_curve, f"""WITH {FORECASTS_SQL}, l AS (SELECT list(width ORDER BY width) AS l, count(*) AS n, least(20, greatest(3, count(*) // 5)) AS bins FROM f),
e AS (SELECT list_distinct(list_transform(range(0, bins + 1), lambda i: l[CAST((n - 1) * i // bins + 1 AS BIGINT)] + (l[CAST(least((n - 1) * i // bins + 2, n) AS BIGINT)] - l[CAST((n - 1) * i // bins + 1 AS BIGINT)]) * (((n - 1) * i % bins) / bins::DOUBLE))) AS edges FROM l)
SELECT CAST(greatest(1, len(list_filter(edges, lambda v: v < width))) AS BIGINT) AS bin, count(*) AS n, round(avg(width), 6) AS interval_width, round(avg(CAST(covered AS INTEGER)), 6) AS empirical_coverage FROM f, e GROUP BY 1""")


def forecast_quality(spark, sf):
    """Calibration and sharpness of the forecasts in one table."""
    crps = X.gaussian_crps(F.col("x"), F.col("predictive_mean"), F.col("predictive_sd"))
    out = B.forecast_quality(_forecasts(spark, sf).drop("width"), "x", "predictive_mean", "predictive_sd", "posterior_sd", crps)
    return out.select("metric", F.round("value", 5).alias("value"))


register("forecast_quality", forecast_quality, f"""WITH {FORECASTS_SQL}, r AS (SELECT *, u * exp(-z * z / 2 + ((((((((0.17087277 * u - 0.82215223) * u + 1.48851587) * u - 1.13520398) * u + 0.27886807) * u - 0.18628806) * u + 0.09678418) * u + 0.37409196) * u + 1.00002368) * u - 1.26551223) / 2 AS tail FROM f),
a AS (SELECT avg(CAST(covered AS INTEGER)) AS c, avg(CAST(abs(x - pm) <= 1.959964 * posterior AS INTEGER)) AS cp, avg(width) AS w, quantile_cont(width, 0.5) AS med, avg({CRPS_SQL}) AS crps, avg(s) AS p, avg(posterior) AS q, avg(sqrt(greatest(s * s - posterior * posterior, 0))) AS o FROM r)
SELECT metric, round(value, 5) AS value FROM (SELECT unnest(['coverage_95', 'coverage_95_param_only', 'coverage_delta', 'mean_sharpness', 'median_sharpness', 'crps', 'mean_predictive_sd', 'mean_posterior_sd', 'mean_observation_sd', 'sharpness_efficiency', 'coverage_penalty']) AS metric,
unnest([c, cp, c - cp, w, med, crps, p, q, o, c / w, abs(c - 0.95)]) AS value FROM a)""")


def trimmed_prior(spark, sf):
    """The prior of all log durations without the outer 5 % at each end, weighted by trust, beside the plain one."""
    c = I.clicks(spark, sf).withColumn("x", F.log1p("duration"))
    plain = B.weighted_moments(c, [], F.col("x"), F.col("trust")).select(F.lit("plain").alias("prior"), "n", "mean", "variance")
    cut = B.trimmed_moments(c, "x", "trust").select(F.lit("trimmed").alias("prior"), "n", "mean", "variance")
    return plain.unionByName(cut).select("prior", "n", r6("mean").alias("mean"), r6("variance").alias("variance"))


register("trimmed_prior", trimmed_prior, f"""WITH {I.CLICKS_SQL}, x AS (SELECT ln(1 + duration) AS x, trust AS w FROM clicks), v AS (SELECT x, count(*) AS n, sum(w) AS w FROM x GROUP BY x), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER () AS total FROM v),
k AS (SELECT x, kept, w * kept / n AS w FROM (SELECT *, greatest(0, least(below + n, total - greatest(1, floor(total * 0.05::DOUBLE))) - greatest(below, greatest(1, floor(total * 0.05::DOUBLE)))) AS kept FROM r))
SELECT 'plain' AS prior, count(*) AS n, round(sum(w * x) / sum(w), 6) AS mean, round(greatest(1e-6, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 6) AS variance FROM x
UNION ALL SELECT 'trimmed', CAST(sum(kept) AS BIGINT), round(sum(w * x) / sum(w), 6), round(greatest(1e-6, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 6) FROM k""")


def _scored(spark, sf):
    c = I.clicks(spark, sf)
    return c.withColumn("p", F.round(X.clip(F.col("trust") * 0.6 + F.when(F.col("duration") > HIGH, 0.35).otherwise(0.05), 0.0, 1.0), 4)).withColumn("y", F.col("duration") > HIGH + F.col("k") / 10)


SCORED_SQL = f"""{I.CLICKS_SQL}, scored AS (SELECT *, round(greatest(0.0, least(1.0, trust * 0.6::DOUBLE + CASE WHEN duration > {HIGH} THEN 0.35::DOUBLE ELSE 0.05::DOUBLE END)), 4) AS p, duration > {HIGH} + k / 10.0::DOUBLE AS y FROM clicks)"""


def calibration_bins_ece(spark, sf):
    bins = B.calibration_bins(_scored(spark, sf), "p", "y")
    return bins.crossJoin(F.broadcast(B.expected_calibration_error(bins).select("ece"))).select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"), r6("ece").alias("ece"))


BINS_SQL = f"""{SCORED_SQL}, bins AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(y AS DOUBLE)) AS rate FROM scored GROUP BY 1)"""
register("calibration_bins_ece", calibration_bins_ece, f"""WITH {BINS_SQL} SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(sum(n * abs(mean_p - rate)) OVER () / sum(n) OVER (), 6) AS ece FROM bins""")


def beta_posterior_bins(spark, sf):
    out = B.beta_posterior(B.calibration_bins(_scored(spark, sf), "p", "y"))
    return out.select("bin", "n", r6("posterior_mean").alias("posterior_mean"), r6("low").alias("low"), r6("high").alias("high"))


register("beta_posterior_bins", beta_posterior_bins)


def classifier_metrics(spark, sf):
    out = B.classification_metrics(_scored(spark, sf), "p", "y")
    return out.select("n", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "brier", "roc_auc")])


register("classifier_metrics", classifier_metrics, f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scored)
SELECT count(*) AS n, round(count(*) FILTER (y AND p >= 0.5) / count(*) FILTER (p >= 0.5)::DOUBLE, 6) AS precision, round(count(*) FILTER (y AND p >= 0.5) / count(*) FILTER (y)::DOUBLE, 6) AS recall,
  round(2 * count(*) FILTER (y AND p >= 0.5) / (count(*) FILTER (p >= 0.5) + count(*) FILTER (y))::DOUBLE, 6) AS f1, round(avg((p - CAST(y AS INTEGER)) ** 2), 6) AS brier,
  round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y))::DOUBLE, 6) AS roc_auc FROM r""")


def f2_threshold_by_cause(spark, sf):
    out = B.tune_thresholds(_scored(spark, sf), "event_cause", "p", "y")
    return out.select("event_cause", r6("threshold").alias("threshold"), r6("score").alias("score"))


register("f2_threshold_by_cause", f2_threshold_by_cause, f"""WITH {SCORED_SQL}, g AS (SELECT unnest(range(0, 50)) AS i), w AS (SELECT 0.9::DOUBLE / 49 AS w),
c AS (SELECT event_cause, greatest(-1, least(49, CAST(floor((p - 0.05::DOUBLE) / (0.9::DOUBLE / 49) + 1e-9) AS INTEGER))) AS step, y FROM scored),
m AS (SELECT event_cause, i, count(*) FILTER (step >= i) AS chosen, count(*) FILTER (step >= i AND y) AS tp, count(*) FILTER (y) AS pos FROM c, g GROUP BY event_cause, i),
s AS (SELECT *, round(coalesce(5.0::DOUBLE * tp / (chosen + 4.0::DOUBLE * pos), 0), 9) AS score FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY event_cause ORDER BY score DESC, i) AS k FROM s)
SELECT event_cause, round(0.05::DOUBLE + i * (0.9::DOUBLE / 49), 6) AS threshold, round(score, 6) AS score FROM b WHERE k = 1""")


def regression_metrics(spark, sf):
    y, p = F.col("duration"), F.col("k") / 2.0
    e = y - p
    return I.clicks(spark, sf).agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.percentile(F.abs(e), F.lit(0.5))).alias("medae"), r6(F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), 2)))).alias("rmsle"), r6(F.avg(F.abs(e) / F.greatest(y, F.lit(1.0)))).alias("mape"), r6(F.percentile(F.abs(e), F.lit(0.9))).alias("conformal_90"))


register("regression_metrics", regression_metrics, f"""WITH {I.CLICKS_SQL}, e AS (SELECT duration AS y, k / 2.0::DOUBLE AS p, duration - k / 2.0::DOUBLE AS e FROM clicks)
SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS medae, round(sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 6) AS rmsle, round(avg(abs(e) / greatest(y, 1.0)), 6) AS mape, round(quantile_cont(abs(e), 0.9), 6) AS conformal_90 FROM e""")


def coverage_grouping_sets(spark, sf):
    from siltstone.operators.relational import grouped_report

    rows = _scored(spark, sf).withColumn("support", F.when(F.col("k") >= 50, "high").otherwise("low"))
    return grouped_report(rows, {"all": [], "cause": ["event_cause"], "corridor": ["corridor"], "support": ["support"]}, [F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("y").cast("double"))).alias("rate")])


register("coverage_grouping_sets", coverage_grouping_sets, f"""WITH {SCORED_SQL}, r AS (SELECT *, CASE WHEN k >= 50 THEN 'high' ELSE 'low' END AS support FROM scored)
SELECT CASE WHEN grouping(event_cause) = 0 THEN 'cause' WHEN grouping(corridor) = 0 THEN 'corridor' WHEN grouping(support) = 0 THEN 'support' ELSE 'all' END AS group_type, coalesce(event_cause, CAST(corridor AS VARCHAR), support, 'all') AS group_value, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate
FROM r GROUP BY GROUPING SETS ((), (event_cause), (corridor), (support))""")
