"""Queries: documents for serving, what-if simulation, institutional memory and network hot spots."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import allocation as A
from siltstone.operators import incidents as I
from siltstone.operators import retrieval as V
from siltstone.operators import spatial as G
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6
from siltstone.plans.q_space import CASES_SQL, SIMILARITY, _cases, _flows, FLOW_SQL

J = I.JUNCTIONS_SQL


def deployment_blueprint(spark, sf):
    """For each zone the units of all its junctions, and its first five tow places by burden as one nested document."""
    j = A.allocate(I.junctions(I.clicks(spark, sf)), "junction", "burden", 300, 4)
    tow = j.withColumn("place", F.row_number().over(W.partitionBy("zone").orderBy(F.desc("burden"), "junction")))
    tow = tow.withColumn("unit", F.format_string("TOW-%03d", "place"))
    items = F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "unit", "junction", "units"))))
    return tow.groupBy("zone").agg(F.sum("units").alias("units"), F.to_json(items).alias("document"))


register("deployment_blueprint", deployment_blueprint, f"""WITH {J}, s AS (SELECT junction, zone, burden, 300.0::DOUBLE * burden / sum(burden) OVER () AS share FROM junctions), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 300 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place0 FROM b), u AS (SELECT *, CAST(base + CASE WHEN place0 <= leftover AND base < 4 THEN 1 ELSE 0 END AS INTEGER) AS units, row_number() OVER (PARTITION BY zone ORDER BY burden DESC, junction) AS place FROM p)
SELECT zone, CAST(sum(units) AS BIGINT) AS units, '[' || string_agg('{{"place":' || place || ',"unit":"TOW-' || lpad(CAST(place AS VARCHAR), 3, '0') || '","junction":' || junction || ',"units":' || units || '}}', ',' ORDER BY place) FILTER (place <= 5) || ']' AS document FROM u GROUP BY zone""")


def institutional_memory(spark, sf):
    """How many similar cases each query has, how alike they are, and an evidence weight by their score."""
    c = _cases(spark, sf)
    good = V.similar_counts(c.where("event_id % 20 = 0"), c, "event_id", *SIMILARITY, 0.5)
    score = F.log1p("n") * F.col("mean_sim")
    weight = X.cases([(score >= 1.5, 0.7), (score >= 0.8, 0.5), (score >= 0.3, 0.3)], 0.1)
    return good.select("query", "n", r6("mean_sim").alias("mean_sim"), r6(score).alias("memory_score"), weight.alias("evidence_weight"))


register("institutional_memory", institutional_memory, f"""WITH {CASES_SQL}, g AS (SELECT query, count(*) AS n, avg(sim) AS m FROM scored WHERE sim >= 0.5 GROUP BY query), s AS (SELECT *, ln(1 + n) * m AS score FROM g)
SELECT query, n, round(m, 6) AS mean_sim, round(score, 6) AS memory_score, CASE WHEN score >= 1.5 THEN 0.7::DOUBLE WHEN score >= 0.8 THEN 0.5::DOUBLE WHEN score >= 0.3 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS evidence_weight FROM s""")


def simulate(cases, request: dict, crowd: float, officers: int):
    """A one-row request through the same retrieval: expected duration from its five best cases, scaled by the
    crowd and shortened by officers, beside the plain expectation. cases and request share their columns."""
    spark = cases.sparkSession
    query = spark.createDataFrame([tuple(request[c] for c in cases.columns)], cases.schema)
    found = V.best_cases(query, cases, "event_id", *SIMILARITY, "planned", "duration")
    best = V.two_stage(found, "query", "case_id", "sim", "planned")
    out = V.predict(best, "query", "sim", "duration")
    factor = max(1.0, min(math.log(1 + crowd / 5000), 2.0))
    clearance = F.col("weighted_mean") * factor * (1 - 0.4 * (1 - math.exp(-0.08 * officers)))
    return out.select("n", r6("weighted_mean").alias("baseline"), r6(clearance).alias("clearance"), r6(clearance - F.col("weighted_mean")).alias("change"), r6("confidence").alias("confidence"))


REQUEST = {"event_id": -1, "price": 200000.0, "month": 6.0, "priority": "1-URGENT", "event_cause": "BUILDING", "corridor": "NATION_3", "duration": None, "planned": True}


def simulate_event(spark, sf):
    return simulate(_cases(spark, sf), REQUEST, 20_000, 12)


register("simulate_event", simulate_event, f"""WITH {CASES_SQL.split("scored AS")[0].rstrip().rstrip(",")},
x AS (SELECT event_id, planned, duration, round(1 - (0.4::DOUBLE * least(1.0, abs(200000.0 - price) / 500000.0::DOUBLE) + 0.2::DOUBLE * least(1.0, abs(6.0 - month) / 11.0::DOUBLE) + 0.25::DOUBLE * CAST(priority <> '1-URGENT' AS INTEGER) + 0.15::DOUBLE * CAST(event_cause <> 'BUILDING' AS INTEGER)), 9) AS sim FROM cases),
g AS (SELECT *, sum(CASE WHEN planned AND sim >= 0.5 THEN 1 ELSE 0 END) OVER () >= 3 AS first_stage FROM x), k AS (SELECT * FROM g WHERE planned OR NOT first_stage ORDER BY sim DESC, event_id LIMIT 5),
p AS (SELECT count(*) AS n, sum(sim * duration) / sum(sim) AS m, least(1.0, count(*) / 3.0::DOUBLE) * avg(sim) AS c FROM k)
SELECT n, round(m, 6) AS baseline, round(m * greatest(1.0, least(ln(1 + 20000 / 5000.0::DOUBLE), 2.0)) * (1 - 0.4 * (1 - exp(-0.08 * 12))), 6) AS clearance, round(m * greatest(1.0, least(ln(1 + 20000 / 5000.0::DOUBLE), 2.0)) * (1 - 0.4 * (1 - exp(-0.08 * 12))) - m, 6) AS change, round(c, 6) AS confidence FROM p""")


def network_hotspots(spark, sf):
    """Gi* over corridors with weights e^(-hops / h) up to 3 h hops, along flows of half the mean or more; of several bandwidths the one of largest variance."""
    flows = _flows(spark, sf)
    flows = flows.crossJoin(F.broadcast(flows.agg(F.avg("weight").alias("usual")))).where("a <> b and weight > usual / 2")
    edges = flows.select("a", "b").union(flows.select("b", "a")).distinct()
    nodes = I.clicks(spark, sf).groupBy(F.col("corridor").alias("node")).agg(F.sum("trust").alias("v"))
    far = G.hops(edges, nodes.select("node"), 6)
    grid = far.withColumn("h", F.explode(F.array(F.lit(1.0), F.lit(2.0)))).where(F.col("hops") <= 3 * F.col("h")).withColumn("w", F.exp(-F.col("hops") / F.col("h")))
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    sums = grid.join(nodes, "node").groupBy("source", "h").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sww") - F.col("sw") * F.col("sw")) / (F.col("n") - 1)))
    z = sums.crossJoin(F.broadcast(total)).withColumn("z", F.when(spread > 1e-9, (F.col("wv") - F.col("mean") * F.col("sw")) / (F.col("sd") * spread)).otherwise(0.0))
    best = z.groupBy("h").agg(F.round(F.var_samp("z"), 9).alias("var")).orderBy(F.desc("var"), "h").limit(1)
    return z.join(F.broadcast(best), "h").select(F.col("source").alias("corridor"), "h", r6("z").alias("z"))


register("network_hotspots", network_hotspots, f"""WITH RECURSIVE {FLOW_SQL}, f AS (SELECT a, b FROM flow WHERE a <> b AND weight > (SELECT avg(weight) FROM flow) / 2), e AS (SELECT a, b FROM f UNION SELECT b, a FROM f), nodes AS (SELECT corridor AS node, sum(trust) AS v FROM clicks GROUP BY corridor),
r AS (SELECT node AS source, node, 0 AS hops FROM nodes UNION SELECT r.source, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 6), d AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY ALL),
g AS (SELECT *, exp(-hops / h) AS w FROM d, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS h) WHERE hops <= 3 * h), t AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM nodes),
s AS (SELECT source, h, sum(w * v) AS wv, sum(w) AS sw, sum(w * w) AS sww FROM g JOIN nodes USING (node) GROUP BY source, h), z AS (SELECT source, h, CASE WHEN sqrt(greatest(0, (n * sww - sw * sw) / (n - 1))) > 1e-9 THEN (wv - mean * sw) / (sd * sqrt(greatest(0, (n * sww - sw * sw) / (n - 1)))) ELSE 0 END AS z FROM s, t),
b AS (SELECT h FROM z GROUP BY h ORDER BY round(var_samp(z), 9) DESC, h LIMIT 1) SELECT source AS corridor, z.h, round(z, 6) AS z FROM z JOIN b ON z.h = b.h""")


def knowledge_base_summaries(spark, sf):
    """For each cause a map from corridor to count and the share of its three commonest corridors."""
    n = I.shipments(spark, sf).groupBy("event_cause", "corridor").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("r", F.row_number().over(W.partitionBy("event_cause").orderBy(F.desc("n"), "corridor")))
    pairs = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "corridor", "n"))))
    doc = F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["corridor"], p["n"]))))
    return top.groupBy("event_cause").agg(F.count(F.lit(1)).alias("corridors"), doc.alias("top_corridors"), r6(F.sum(F.when(F.col("r") <= 3, F.col("n"))) / F.sum("n")).alias("share"))


register("knowledge_base_summaries", knowledge_base_summaries, f"""WITH {I.SHIPMENTS_SQL}, n AS (SELECT event_cause, corridor, count(*) AS n FROM shipments GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY event_cause ORDER BY n DESC, corridor) AS r FROM n)
SELECT event_cause, count(*) AS corridors, '{{' || string_agg('"' || corridor || '":' || n, ',' ORDER BY r) FILTER (r <= 3) || '}}' AS top_corridors, round(sum(n) FILTER (r <= 3) / sum(n)::DOUBLE, 6) AS share FROM t GROUP BY event_cause""")


def bootstrap_hotspots(spark, sf):
    """The share of resamples, rows weighted by a Poisson number of their own, in which a junction's z is 1.96 or more."""
    c = I.clicks(spark, sf).select("event_id", "junction", "trust")
    draws = 20
    u = lambda b: (F.pmod(F.xxhash64("event_id", F.lit(b), F.lit(42)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    times = lambda b: X.cases([(u(b) < 0.36787944, 0), (u(b) < 0.73575888, 1), (u(b) < 0.9196986, 2), (u(b) < 0.98101184, 3)], 4)
    sums = c.groupBy("junction").agg(*[F.sum(F.col("trust") * times(b)).alias(f"s{b}") for b in range(draws)])
    part = W.partitionBy()
    hot = sum(((F.col(f"s{b}") - F.avg(f"s{b}").over(part)) / F.stddev_pop(f"s{b}").over(part) >= 1.96).cast("int") for b in range(draws))
    return sums.select("junction", (hot / draws).alias("p_hot"))


register("bootstrap_hotspots", bootstrap_hotspots)
