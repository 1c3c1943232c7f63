"""Queries: hot spots over several scales, classes of branching ratios, predictive checks, sample sizes, city totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import allocation as A
from siltstone.operators import bayes as B
from siltstone.operators import incidents as I
from siltstone.operators import relational as R
from siltstone.operators import reports as T
from siltstone.operators import spatial as G
from siltstone.operators import temporal as M
from siltstone.plans import q_time  # noqa: F401  (its SQL is built on below)
from siltstone.plans.catalogue import SQL, register
from siltstone.plans.q_core import r6
from siltstone.plans.q_serve import FLOW_SQL, _flows
from siltstone.plans.q_space import SCENARIOS, J, _junctions

SCALES = (1, 2, 3, 5)


def multiscale_network_index(spark, sf):
    """Mean Gi* (sps) and mean percentile rank (nhi) of corridors over bandwidths, weights e^(-hops / h) up to 3 h hops.

    An edge joins corridors that share at least 1/500 of all moves between corridors.
    """
    flows = _flows(spark, sf).where("a <> b")
    whole = flows.agg(F.sum("weight").alias("whole"))
    flows = flows.crossJoin(F.broadcast(whole)).where(F.col("weight") * 500 >= F.col("whole"))
    edges = flows.select("a", "b").union(flows.select("b", "a")).distinct()
    nodes = I.clicks(spark, sf).groupBy(F.col("corridor").alias("node")).agg(F.sum("trust").alias("v"))
    far = G.hops(edges, nodes.select("node"), 3 * max(SCALES))
    grid = far.withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in SCALES]))).where(F.col("hops") <= 3 * F.col("h")).withColumn("w", F.exp(-F.col("hops") / F.col("h")))
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    sums = grid.join(nodes, "node").groupBy("source", "h").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sww") - F.col("sw") * F.col("sw")) / (F.col("n") - 1)))
    z = sums.crossJoin(F.broadcast(total)).withColumn("z", r6(F.when(spread > 1e-9, (F.col("wv") - F.col("mean") * F.col("sw")) / (F.col("sd") * spread)).otherwise(0.0)))
    ranked = z.withColumn("rank", R.rank_percent(F.col("z"), ["h"]))
    by_scale = [F.max(F.when(F.col("h") == h, F.col("z"))).alias(f"z_h{h}") for h in SCALES]
    return ranked.groupBy(F.col("source").alias("corridor")).agg(*by_scale, r6(F.avg("z")).alias("sps"), r6(F.avg("rank")).alias("nhi"))


register("multiscale_network_index", multiscale_network_index, f"""WITH RECURSIVE {FLOW_SQL}, f AS (SELECT a, b FROM flow WHERE a <> b AND weight * 500 >= (SELECT sum(weight) FROM flow WHERE a <> b)), e AS (SELECT a, b FROM f UNION SELECT b, a FROM f), nodes AS (SELECT corridor AS node, sum(trust) AS v FROM clicks GROUP BY corridor),
r AS (SELECT node AS source, node, 0 AS hops FROM nodes UNION SELECT r.source, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 15), d AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY ALL),
g AS (SELECT *, exp(-hops / h) AS w FROM d, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE]) AS h) WHERE hops <= 3 * h), t AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM nodes),
s AS (SELECT source, h, sum(w * v) AS wv, sum(w) AS sw, sum(w * w) AS sww FROM g JOIN nodes USING (node) GROUP BY source, h), z AS (SELECT source, h, round(CASE WHEN sqrt(greatest(0, (n * sww - sw * sw) / (n - 1))) > 1e-9 THEN (wv - mean * sw) / (sd * sqrt(greatest(0, (n * sww - sw * sw) / (n - 1)))) ELSE 0 END, 6) AS z FROM s, t),
k AS (SELECT *, (rank() OVER (PARTITION BY h ORDER BY z) + (count(*) OVER (PARTITION BY h, z) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY h) AS rank FROM z)
SELECT source AS corridor, {", ".join(f"max(CASE WHEN h = {h} THEN z END) AS z_h{h}" for h in SCALES)}, round(avg(z), 6) AS sps, round(avg(rank), 6) AS nhi FROM k GROUP BY source""")


def branching_classes(spark, sf):
    """Branching ratio of junctions, excitation over decay: rates an hour from the first 75 % of the time, decay 0.1."""
    c = I.early(I.clicks(spark, sf), 0.75).where("early")
    hours = c.agg(F.greatest((F.max("t") - F.min("t")) / M.HOUR, F.lit(1.0)).alias("hours"))
    rates = c.groupBy("junction").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(hours)).withColumn("mu", F.col("n") / F.col("hours"))
    out = rates.withColumn("branching_ratio", r6(F.least(F.lit(0.3), F.col("mu") * 0.4) / 0.1))
    level = F.when(F.col("branching_ratio") < 0.3, "weak").when(F.col("branching_ratio") <= 0.7, "moderate").otherwise("strong")
    return out.select("junction", r6("mu").alias("mu"), "branching_ratio", level.alias("cascade_class"))


register("branching_classes", branching_classes, f"""WITH {I.CLICKS_SQL}, c AS (SELECT * FROM clicks WHERE {I.early_sql(0.75)}), h AS (SELECT greatest((max(t) - min(t)) / 3600000000.0::DOUBLE, 1) AS hours FROM c),
m AS (SELECT junction, count(*) / any_value(hours) AS mu FROM c, h GROUP BY junction), b AS (SELECT junction, mu, round(least(0.3::DOUBLE, mu * 0.4::DOUBLE) / 0.1::DOUBLE, 6) AS branching_ratio FROM m)
SELECT junction, round(mu, 6) AS mu, branching_ratio, CASE WHEN branching_ratio < 0.3 THEN 'weak' WHEN branching_ratio <= 0.7 THEN 'moderate' ELSE 'strong' END AS cascade_class FROM b""")


def _posterior(spark, sf):
    """Feedback rows with their log durations, and the posterior of each stratum."""
    c = I.early(I.clicks(spark, sf), 0.75).withColumn("area", F.col("junction") % 97).withColumn("x", F.log1p("duration"))
    feedback = c.where("not early").crossJoin(F.broadcast(c.agg(F.max("t").alias("last"))))
    w = B.forgetting(F.floor((F.col("last") - F.col("t")) / M.DAY))
    keys = ["event_cause", "area"]
    return feedback, B.normal_posterior(c.where("early"), keys, feedback, F.col("x"), w, keys)


_POSTERIOR_SQL = SQL["hierarchical_posterior"].split("\nSELECT event_cause")[0] + """,
o AS (SELECT *, CASE WHEN n_eff >= 1 THEN (pm / pv + n_eff * fm / pv) / (1 / pv + n_eff / pv) ELSE pm END AS m1, CASE WHEN n_eff >= 1 THEN 1 / (1 / pv + n_eff / pv) ELSE pv END AS v1 FROM j)"""


def sample_size_summary(spark, sf):
    """Effective sample size, width of the 95 % interval and prior influence of each stratum; the prior dominates if its
    influence, rounded to nine places, is above a half."""
    _, out = _posterior(spark, sf)
    sigma = F.sqrt("posterior_variance")
    return out.select("event_cause", "area", "level", r6("n_eff").alias("n_eff"), r6(2 * 1.96 * sigma).alias("ci95_width"), r6("prior_influence").alias("prior_influence"), r6(1 - F.col("prior_influence")).alias("posterior_influence"), (F.round("prior_influence", 9) > 0.5).alias("prior_dominated"), F.when(sigma > 1.5, "high").otherwise("ok").alias("uncertainty"))


register("sample_size_summary", sample_size_summary, f"""{_POSTERIOR_SQL}, q AS (SELECT *, greatest(0, least(1, v1 / pv)) AS part FROM o)
SELECT event_cause, area, level, round(n_eff, 6) AS n_eff, round(2 * 1.96::DOUBLE * sqrt(v1), 6) AS ci95_width, round(part, 6) AS prior_influence, round(1 - part, 6) AS posterior_influence, round(part, 9) > 0.5 AS prior_dominated, CASE WHEN sqrt(v1) > 1.5 THEN 'high' ELSE 'ok' END AS uncertainty FROM q""")

Z = {50: 0.674490, 80: 1.281552, 95: 1.959964}


def predictive_checks(spark, sf):
    """Feedback held against each stratum's predictive distribution: coverage, mean error, lower tail, divergence.

    The predictive variance is the posterior's and the observations' (of one observation alone: the prior's)."""
    feedback, out = _posterior(spark, sf)
    keys = ["event_cause", "area"]
    seen = feedback.groupBy(*keys).agg(F.var_samp("x").alias("variance"))
    states = out.select(*keys, "level", "prior_mean", "prior_variance", "posterior_mean", "posterior_variance").join(seen, keys)
    rows = feedback.select(*keys, "x").join(states, keys)
    sd = F.sqrt(F.col("posterior_variance") + F.coalesce("variance", "prior_variance"))
    away = F.col("x") - F.col("posterior_mean")
    within = lambda z, s: F.avg((F.abs(away) <= z * s).cast("double"))
    kl = 0.5 * F.log(F.col("posterior_variance") / F.col("prior_variance")) + (F.col("prior_variance") + (F.col("prior_mean") - F.col("posterior_mean")) ** 2) / (2 * F.col("posterior_variance")) - 0.5
    return rows.groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n_obs"), r6(F.max(sd)).alias("predictive_sd"), r6(F.avg(away)).alias("mean_error"), *[r6(within(z, sd)).alias(f"coverage_{p}") for p, z in Z.items()],
        r6(within(Z[95], F.sqrt("posterior_variance"))).alias("coverage_95_parameter"), r6(F.abs(F.avg((away < -Z[95] * sd).cast("double")) - 0.025)).alias("tail_discrepancy"), r6(F.max(kl)).alias("kl"),
    )


register("predictive_checks", predictive_checks, f"""{_POSTERIOR_SQL}, fb AS (SELECT event_cause, area, x FROM x WHERE NOT {I.early_sql(0.75)}), sv AS (SELECT event_cause, area, var_samp(x) AS v FROM fb GROUP BY ALL),
y AS (SELECT event_cause, area, level, x - m1 AS away, sqrt(v1 + coalesce(sv.v, pv)) AS sd, pm, pv, m1, v1 FROM fb JOIN o USING (event_cause, area) JOIN sv USING (event_cause, area))
SELECT event_cause, area, level, count(*) AS n_obs, round(max(sd), 6) AS predictive_sd, round(avg(away), 6) AS mean_error, {", ".join(f"round(avg((abs(away) <= {z}::DOUBLE * sd)::INT), 6) AS coverage_{p}" for p, z in Z.items())},
  round(avg((abs(away) <= {Z[95]}::DOUBLE * sqrt(v1))::INT), 6) AS coverage_95_parameter, round(abs(avg((away < -{Z[95]}::DOUBLE * sd)::INT) - 0.025), 6) AS tail_discrepancy, round(max(0.5 * ln(v1 / pv) + (pv + (pm - m1) ** 2) / (2 * v1) - 0.5), 6) AS kl FROM y GROUP BY ALL""")


def city_counterfactuals(spark, sf):
    """Totals over all sites of each resource scenario: minutes saved, their share of what can be saved, sites improved."""
    sites = A.allocate(_junctions(spark, sf), "junction", "burden", 300, 4).crossJoin(F.broadcast(spark.createDataFrame([(name, float(s.get("officers", 0)), float(s.get("tow", 0))) for name, s in SCENARIOS.items()], "scenario string, o double, w double")))
    effect = lambda o, w: X.effectiveness([(F.col("units") + o, 0.18), (F.col("closure_rate") + w, 0.25)])
    base, new = effect(F.lit(0.0), F.lit(0.0)), effect(F.col("o"), F.col("w"))
    weight = F.col("mean_duration") * F.log1p("burden")
    out = sites.groupBy("scenario", "o", "w").agg(F.sum(weight * (new - base)).alias("saved"), F.sum(weight * F.greatest(F.lit(0.0), 0.9 - base)).alias("most"), F.count_if(new - base > 0.01).alias("sites_improved"))
    share = F.when(F.col("most") > 1e-9, F.col("saved") / F.col("most") * 100).otherwise(0.0)
    units = F.col("o") + F.col("w")
    return out.select("scenario", r6("saved").alias("minutes_saved"), r6(share).alias("percent_of_reducible"), "sites_improved", r6(F.when(units > 0, share / units).otherwise(0.0)).alias("percent_per_unit"))


register("city_counterfactuals", city_counterfactuals, f"""WITH {J}, s AS (SELECT *, 300.0::DOUBLE * burden / sum(burden) OVER () AS share FROM junctions), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 300 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM b), u AS (SELECT *, base + CASE WHEN place <= leftover AND base < 4 THEN 1 ELSE 0 END AS units FROM p),
g(scenario, o, w) AS (VALUES ('base', 0, 0), ('officers+2', 2, 0), ('tow+1', 0, 1), ('both', 2, 1)),
e AS (SELECT scenario, o, w, mean_duration * ln(1 + burden) AS weight, least(0.9, 1 - exp(-(units * 0.18::DOUBLE + closure_rate * 0.25::DOUBLE))) AS e0, least(0.9, 1 - exp(-((units + o) * 0.18::DOUBLE + (closure_rate + w) * 0.25::DOUBLE))) AS e1 FROM u, g),
t AS (SELECT scenario, o + w AS units, sum(weight * (e1 - e0)) AS saved, sum(weight * greatest(0, 0.9 - e0)) AS most, count(*) FILTER (WHERE e1 - e0 > 0.01) AS sites_improved FROM e GROUP BY ALL)
SELECT scenario, round(saved, 6) AS minutes_saved, round(CASE WHEN most > 1e-9 THEN saved / most * 100 ELSE 0 END, 6) AS percent_of_reducible, sites_improved, round(CASE WHEN units > 0 AND most > 1e-9 THEN saved / most * 100 / units ELSE 0 END, 6) AS percent_per_unit FROM t""")


LEVELS = {"everything": [], "cause": ["event_cause"], "cause_corridor": ["event_cause", "corridor"]}


def model_averaging(spark, sf):
    """Weights of competing models by their scores on the last quarter of the time: log durations by CRPS, closures by Brier
    score, each at several levels of detail, and one model of high impact that has no rival."""
    c = I.early(I.clicks(spark, sf), 0.75).withColumns({"x": F.log1p("duration"), "high": (F.col("duration") > q_time.HIGH).cast("double"), "shut": F.col("closure").cast("double")})
    late, scored = c.where("not early"), []
    for name, keys in LEVELS.items():
        fit = c.where("early").groupBy(*keys).agg(F.avg("x").alias("m"), F.greatest(F.coalesce(F.stddev_pop("x"), F.lit(0.0)), F.lit(0.05)).alias("s"), F.avg("shut").alias("p"), F.avg("high").alias("q"))
        both = late.join(fit, keys) if keys else late.crossJoin(F.broadcast(fit))
        rules = {"duration": X.gaussian_crps(F.col("x"), F.col("m"), F.col("s")), "closure": F.pow(F.col("shut") - F.col("p"), 2), **({} if keys else {"impact": F.pow(F.col("high") - F.col("q"), 2)})}
        means = both.agg(*[F.avg(rule).alias(family) for family, rule in rules.items()])
        scored.append(means.select(F.inline(F.array(*[F.struct(F.lit(family).alias("family"), F.lit(name).alias("model"), F.round(family, 5).alias("score")) for family in rules]))))
    out = T.averaging_weights(scored[0].unionByName(scored[1]).unionByName(scored[2]))
    return out.select("family", "model", "score", F.round("z", 4).alias("z"), F.round("weight", 4).alias("weight"), "confident")


def _level_sql(name: str, keys: list[str]) -> str:
    on, by = (f"JOIN fit_{name} f USING ({', '.join(keys)})", f"GROUP BY {', '.join(keys)}") if keys else (f", fit_{name} f", "")
    return f"""fit_{name} AS (SELECT {', '.join([*keys, ''])}avg(x) AS m, greatest(coalesce(stddev_pop(x), 0), 0.05) AS s, avg(shut) AS p, avg(high) AS q FROM c WHERE early {by}),
both_{name} AS (SELECT x, shut, high, m, s, p, q, (x - m) / s AS z, 1 / (1 + abs((x - m) / s) / sqrt(2) * 0.5) AS u FROM c {on} WHERE NOT early),
score_{name} AS (SELECT avg({q_time.CRPS_SQL}) AS duration, avg((shut - p) ** 2) AS closure, avg((high - q) ** 2) AS impact FROM (SELECT *, u * exp(-z * z / 2 + ((((((((0.17087277 * u - 0.82215223) * u + 1.48851587) * u - 1.13520398) * u + 0.27886807) * u - 0.18628806) * u + 0.09678418) * u + 0.37409196) * u + 1.00002368) * u - 1.26551223) / 2 AS tail FROM both_{name}))"""


register("model_averaging", model_averaging, f"""WITH {I.CLICKS_SQL}, c AS (SELECT *, ln(1 + duration) AS x, CAST(duration > {q_time.HIGH} AS INTEGER) AS high, CAST(closure AS INTEGER) AS shut, {I.early_sql(0.75)} AS early FROM clicks),
{", ".join(_level_sql(n, k) for n, k in LEVELS.items())},
scores AS ({" UNION ALL ".join(f"SELECT '{family}' AS family, '{n}' AS model, round({family}, 5) AS score FROM score_{n}" for n, k in LEVELS.items() for family in ("duration", "closure", "impact") if not k or family != "impact")}),
m AS (SELECT family, median(score) AS med, count(*) AS models FROM scores GROUP BY family), a AS (SELECT s.*, models, score - med AS d, median(abs(score - med)) OVER (PARTITION BY family) AS mad FROM scores s JOIN m USING (family)),
z AS (SELECT *, CASE WHEN models > 1 THEN d / (1.4826::DOUBLE * mad + 1e-8) END AS z FROM a), w AS (SELECT *, exp(-(z - min(z) OVER (PARTITION BY family))) AS g FROM z)
SELECT family, model, score, round(z, 4) AS z, round(g / sum(g) OVER (PARTITION BY family), 4) AS weight, models > 1 AS confident FROM w""")
