"""Queries: places, hot spots, graphs, retrieval, allocation and indices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import allocation as A
from siltstone.operators import incidents as I
from siltstone.operators import medoids as K
from siltstone.operators import relational as R
from siltstone.operators import retrieval as V
from siltstone.operators import spatial as G
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6
from siltstone.sources.tables import table


def _junctions(spark, sf):
    return I.junctions(I.clicks(spark, sf))


J = I.JUNCTIONS_SQL
KNN_SQL = f"""{J}, pairs AS (SELECT a.junction, b.junction AS neighbour, (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2 AS d2 FROM junctions a JOIN junctions b ON a.junction <> b.junction),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY d2, neighbour) AS k FROM pairs) WHERE k <= 6)"""


def severity_hotspots(spark, sf):
    c = I.shipments(spark, sf).where(F.col("junction").isNotNull() & ~F.col("is_censored") & (F.col("duration") >= 0))
    weight = X.lookup(F.col("priority"), {"1-URGENT": 3.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0}, 1.0)
    out = c.groupBy("junction").agg(F.sum(F.col("trust") * F.log1p("duration") * weight).alias("score"), F.count(F.lit(1)).alias("raw_count"), F.avg("duration").alias("mean_duration"))
    return out.orderBy(F.desc("score"), "junction").limit(50).select("junction", r6("score").alias("score"), "raw_count", r6("mean_duration").alias("mean_duration"))


register("severity_hotspots", severity_hotspots, f"""
WITH {I.SHIPMENTS_SQL}, s AS (SELECT junction, sum(trust * ln(1 + duration) * CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 3.0 WHEN priority = '3-MEDIUM' THEN 2.0 ELSE 1.0 END) AS score, count(*) AS raw_count, avg(duration) AS mean_duration
  FROM shipments WHERE junction IS NOT NULL AND NOT is_censored AND duration >= 0 GROUP BY junction)
SELECT junction, round(score, 6) AS score, raw_count, round(mean_duration, 6) AS mean_duration FROM s ORDER BY s.score DESC, junction LIMIT 50""")


def getis_ord_z(spark, sf):
    j = _junctions(spark, sf)
    z = G.getis_ord(j, G.nearest_neighbours(j, "junction", 6), "junction", "burden")
    return z.select("junction", r6("z").alias("z"), (F.col("z") >= 1.96).alias("hot"))


register("getis_ord_z", getis_ord_z, f"""WITH {KNN_SQL}, w AS (SELECT junction, neighbour FROM knn UNION ALL SELECT junction, junction FROM junctions),
t AS (SELECT count(*) AS n, avg(burden) AS mean, stddev_pop(burden) AS sd FROM junctions), l AS (SELECT w.junction, count(*) AS m, avg(j.burden) AS local FROM w JOIN junctions j ON j.junction = w.neighbour GROUP BY w.junction),
z AS (SELECT junction, (local - mean) / (sd * sqrt((n / m::DOUBLE - 1) / (n - 1))) AS z FROM l, t) SELECT junction, round(z, 6) AS z, z >= 1.96 AS hot FROM z""")


def knn_weights(spark, sf):
    return G.nearest_neighbours(_junctions(spark, sf), "junction", 6).select("junction", "neighbour", F.round("d2", 9).alias("d2"), "rank")


register("knn_weights", knn_weights, f"WITH {KNN_SQL} SELECT junction, neighbour, round(d2, 9) AS d2, CAST(k AS INTEGER) AS rank FROM knn")


def radius_matches(spark, sf):
    j = _junctions(spark, sf)
    return G.within_radius(j, j, 5.0, "junction", "junction", digits=6)


register("radius_matches", radius_matches, f"""WITH {J}, d AS (SELECT a.junction, b.junction AS near_junction, 2 * 6371 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) AS km FROM junctions a, junctions b)
SELECT junction, near_junction, round(km, 6) AS km FROM d WHERE km <= 5.0""")


def persistence_weeks(spark, sf):
    c = I.clicks(spark, sf).groupBy("junction", F.floor((F.col("t") / 86_400_000_000 + 3) / 7).alias("week")).agg(F.sum("trust").alias("burden"))
    part = W.partitionBy("week")
    z = c.withColumn("z", (F.col("burden") - F.avg("burden").over(part)) / F.stddev_pop("burden").over(part))
    out = z.groupBy("junction").agg(F.count_if(F.col("z") >= 1.0).alias("significant_weeks"), F.count(F.lit(1)).alias("total_weeks"))
    share = F.col("significant_weeks") / F.col("total_weeks")
    return out.select("junction", "significant_weeks", "total_weeks", r6(share).alias("persistence"), X.cases([(share >= 0.5, "persistent"), (share > 0, "recurring")], "rare").alias("class"))


register("persistence_weeks", persistence_weeks, f"""
WITH {I.CLICKS_SQL}, w AS (SELECT junction, CAST(floor((t / 86400000000.0::DOUBLE + 3) / 7) AS BIGINT) AS week, sum(trust) AS burden FROM clicks GROUP BY ALL),
z AS (SELECT junction, (burden - avg(burden) OVER (PARTITION BY week)) / stddev_pop(burden) OVER (PARTITION BY week) AS z FROM w), s AS (SELECT junction, count(*) FILTER (z >= 1.0) AS significant_weeks, count(*) AS total_weeks FROM z GROUP BY junction)
SELECT junction, significant_weeks, total_weeks, round(significant_weeks / total_weeks::DOUBLE, 6) AS persistence, CASE WHEN significant_weeks / total_weeks::DOUBLE >= 0.5 THEN 'persistent' WHEN significant_weeks > 0 THEN 'recurring' ELSE 'rare' END AS class FROM s""")

COMPONENTS = ["n", "mean_duration", "burden"]


def burden_index_entropy(spark, sf):
    j = _junctions(spark, sf).withColumns({f"{c}_01": R.min_max(c, 0.5) for c in COMPONENTS})
    w = R.entropy_weights(j, COMPONENTS).groupBy().pivot("component", COMPONENTS).agg(F.first("weight"))
    w = w.select(*[F.col(c).alias(f"{c}_w") for c in COMPONENTS])
    score = sum((F.col(f"{c}_01") * F.col(f"{c}_w") for c in COMPONENTS), F.lit(0.0))
    equal = sum((F.col(f"{c}_01") for c in COMPONENTS), F.lit(0.0)) / 3
    return j.crossJoin(F.broadcast(w)).select("junction", r6(score * 100).alias("entropy_score"), r6(equal * 100).alias("equal_score"), r6((score + equal) * 50).alias("burden_index"))


register("burden_index_entropy", burden_index_entropy, f"""WITH {J}, n01 AS (SELECT junction, {", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE AS {c}01" for c in COMPONENTS)} FROM junctions),
s AS (SELECT count(*) AS k, {", ".join(f"sum({c}) AS {c}_t" for c in COMPONENTS)} FROM junctions), e AS (SELECT any_value(k) AS k, {", ".join(f"1 - sum(-{c} / {c}_t::DOUBLE * ln({c} / {c}_t::DOUBLE)) / ln(any_value(k)) AS {c}_e" for c in COMPONENTS)} FROM junctions, s),
r AS (SELECT junction, ({" + ".join(f"{c}01 * {c}_e" for c in COMPONENTS)}) / ({" + ".join(f"{c}_e" for c in COMPONENTS)}) AS ent, ({" + ".join(f"{c}01" for c in COMPONENTS)}) / 3 AS eq FROM n01, e)
SELECT junction, round(ent * 100, 6) AS entropy_score, round(eq * 100, 6) AS equal_score, round((ent + eq) * 50, 6) AS burden_index FROM r""")

# --- graphs over zones: nations linked by shared suppliers' regions


def _members(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("corridor"), F.col("s_acctbal").alias("w"))


def corridor_cliques(spark, sf):
    return G.clique_degrees(_members(spark, sf), "node", "corridor")


register("corridor_cliques", corridor_cliques, "SELECT a.s_suppkey AS a, count(*) AS degree, max(b.s_suppkey) AS last FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1")


def chain_edges(spark, sf):
    return G.chain_edges(_members(spark, sf), "node", "corridor", [F.desc("w")])


CHAIN_SQL = """chain0 AS (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS b, s_acctbal FROM supplier),
chain AS (SELECT a, b FROM chain0 WHERE b IS NOT NULL UNION SELECT b, a FROM chain0 WHERE b IS NOT NULL)"""
register("chain_edges", chain_edges, f"WITH {CHAIN_SQL} SELECT a, b FROM chain")


def bfs_hops(spark, sf):
    e = G.chain_edges(_members(spark, sf), "node", "corridor", [F.desc("w")])
    sources = _members(spark, sf).select("node")
    return G.hops(e, sources, 4)


register("bfs_hops", bfs_hops, f"""WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT s_suppkey AS source, s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT r.source, c.b, r.hops + 1 FROM r JOIN chain c ON r.node = c.a WHERE r.hops < 4)
SELECT source, node, min(hops) AS hops FROM r GROUP BY ALL""")


def cheapest_diversion(spark, sf):
    m = _members(spark, sf)
    cost = m.select(F.col("node").alias("b"), (0.1 + F.col("node") % 7 / 10.0).alias("weight"))
    e = G.chain_edges(m, "node", "corridor", [F.desc("w")]).join(cost, "b")
    # start at the neighbours of a blocked node and stay off it
    sources = e.select(F.col("a").alias("blocked"), F.col("b").alias("node")).withColumn("source", F.col("node"))
    out = G.cheapest_paths(e, sources, 2.0).where(F.col("source") != F.col("node"))
    best = R.top_k_per(out, ["blocked"], [F.round("cost", 6), F.col("source"), F.col("node")], 3)
    return best.select("blocked", "source", "node", r6("cost").alias("cost"), "rank")


register("cheapest_diversion", cheapest_diversion, f"""WITH RECURSIVE {CHAIN_SQL}, r AS (
  SELECT a AS blocked, b AS source, b AS node, 0.0::DOUBLE AS cost, 0 AS steps FROM chain
  UNION SELECT r.blocked, r.source, c.b, r.cost + 0.1::DOUBLE + c.b % 7 / 10.0::DOUBLE, r.steps + 1 FROM r JOIN chain c ON c.a = r.node WHERE c.b <> r.blocked AND r.cost + 0.1::DOUBLE + c.b % 7 / 10.0::DOUBLE <= 2.0),
m AS (SELECT blocked, source, node, min(cost) AS cost FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY blocked ORDER BY round(cost, 6), source, node) AS rank FROM m WHERE source <> node)
SELECT blocked, source, node, round(cost, 6) AS cost, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")


def _flows(spark, sf):
    c = I.clicks(spark, sf)
    nxt = c.withColumn("b", F.lead("corridor").over(W.partitionBy("junction").orderBy("t", "event_id"))).withColumn("b", (F.col("b") + F.col("k") % 3) % 10)
    return nxt.where("b is not null").groupBy(F.col("corridor").alias("a"), "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


FLOW_SQL = f"""{I.CLICKS_SQL}, nx AS (SELECT corridor AS a, (lead(corridor) OVER (PARTITION BY junction ORDER BY t, event_id) + k % 3) % 10 AS b FROM clicks), flow AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM nx WHERE b IS NOT NULL GROUP BY ALL)"""


def pagerank_zones(spark, sf):
    return G.pagerank(_flows(spark, sf), rounds=8).select("node", r6("rank").alias("rank"))


register("pagerank_zones", pagerank_zones, f"""WITH {FLOW_SQL}, nodes AS (SELECT a AS node FROM flow UNION SELECT b FROM flow), sh AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS s FROM flow), n AS (SELECT count(*) AS n FROM nodes),
r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n){"".join(f", r{i} AS (SELECT x.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce((SELECT sum(r.rank * s) FROM sh JOIN r{i - 1} r ON r.node = sh.a WHERE sh.b = x.node), 0) AS rank FROM nodes x, n)" for i in range(1, 9))}
SELECT node, round(rank, 6) AS rank FROM r8""")


def centrality_sums(spark, sf):
    e = _flows(spark, sf).where("a <> b")
    out, into = e.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("out_sum")), e.groupBy(F.col("b").alias("node")).agg(F.sum("weight").alias("in_sum"))
    both = out.join(into, "node", "full").fillna(0.0)
    return both.withColumn("total", F.col("out_sum") + F.col("in_sum")).withColumn("scaled", r6(R.min_max("total", 0.5)))


register("centrality_sums", centrality_sums, f"""WITH {FLOW_SQL}, e AS (SELECT * FROM flow WHERE a <> b), o AS (SELECT a AS node, sum(weight) AS out_sum FROM e GROUP BY a), i AS (SELECT b AS node, sum(weight) AS in_sum FROM e GROUP BY b),
t AS (SELECT node, coalesce(out_sum, 0) AS out_sum, coalesce(in_sum, 0) AS in_sum FROM o FULL JOIN i USING (node)), s AS (SELECT *, out_sum + in_sum AS total FROM t)
SELECT node, out_sum, in_sum, total, round(CASE WHEN max(total) OVER () > min(total) OVER () THEN (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) ELSE 0.5 END, 6) AS scaled FROM s""")


def knowledge_graph_edges(spark, sf):
    c = I.shipments(spark, sf)
    outcome = X.cases([(F.col("duration") < 0, "invalid"), (F.col("duration") < 500, "short")], "long")
    rows = c.where(F.col("duration").isNotNull()).withColumn("outcome", outcome)
    one = rows.groupBy(F.col("corridor").alias("source_node"), F.col("event_cause").alias("target_node")).agg(F.count(F.lit(1)).cast("double").alias("edge_weight")).withColumn("edge_label", F.lit("has_cause"))
    shares = rows.groupBy(F.col("event_cause").alias("source_node"), F.col("outcome").alias("target_node")).agg(F.count(F.lit(1)).alias("n"))
    two = shares.withColumn("edge_weight", F.round(F.col("n") / F.sum("n").over(W.partitionBy("source_node")), 6)).withColumn("edge_label", F.lit("leads_to")).drop("n")
    return one.unionByName(two)


register("knowledge_graph_edges", knowledge_graph_edges, f"""WITH {I.SHIPMENTS_SQL}, r AS (SELECT *, CASE WHEN duration < 0 THEN 'invalid' WHEN duration < 500 THEN 'short' ELSE 'long' END AS outcome FROM shipments WHERE duration IS NOT NULL), s AS (SELECT event_cause, outcome, count(*) AS n FROM r GROUP BY ALL)
SELECT corridor AS source_node, event_cause AS target_node, CAST(count(*) AS DOUBLE) AS edge_weight, 'has_cause' AS edge_label FROM r GROUP BY 1, 2 UNION ALL SELECT event_cause, outcome, round(n / sum(n) OVER (PARTITION BY event_cause)::DOUBLE, 6), 'leads_to' FROM s""")

# --- retrieval
CASE_COLUMNS = ["event_id", "price", "month", "priority", "event_cause", "corridor", "duration", "planned"]
RANGES, WEIGHTS = {"price": 500000.0, "month": 11.0}, {"price": 0.4, "month": 0.2, "priority": 0.25, "event_cause": 0.15}


def _cases(spark, sf):
    c = I.shipments(spark, sf).where(~F.col("is_censored") & (F.col("duration") > 0)).withColumn("month", F.month("start_ts").cast("double")).withColumn("planned", F.col("priority").isin("1-URGENT", "2-HIGH"))
    return c.select(*CASE_COLUMNS)


SIMILARITY = (RANGES, ["priority", "event_cause"], WEIGHTS)


def _best_cases(spark, sf):
    c = _cases(spark, sf)
    return V.best_cases(c.where("event_id % 20 = 0"), c, "event_id", *SIMILARITY, "planned", "duration")


CASES_SQL = f"""{I.SHIPMENTS_SQL}, cases AS (SELECT event_id, price, CAST(month(start_ts) AS DOUBLE) AS month, priority, event_cause, corridor, duration, priority IN ('1-URGENT', '2-HIGH') AS planned FROM shipments WHERE NOT is_censored AND duration > 0),
scored AS (SELECT q.event_id AS query, c.event_id AS case_id, round(1 - (0.4::DOUBLE * least(1.0, abs(q.price - c.price) / 500000.0::DOUBLE) + 0.2::DOUBLE * least(1.0, abs(q.month - c.month) / 11.0::DOUBLE) + 0.25::DOUBLE * CAST(q.priority <> c.priority AS INTEGER) + 0.15::DOUBLE * CAST(q.event_cause <> c.event_cause AS INTEGER)), 9) AS sim,
  c.planned, c.duration, q.duration AS actual FROM cases q JOIN cases c ON q.event_id <> c.event_id WHERE q.event_id % 20 = 0)"""


def gower_topk(spark, sf):
    best = R.top_k_per(_best_cases(spark, sf), ["query"], [F.desc("sim"), F.col("case_id")], 5)
    return best.select("query", "case_id", r6("sim").alias("sim"), "rank")


register("gower_topk", gower_topk, f"WITH {CASES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, case_id) AS rank FROM scored) SELECT query, case_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")


def two_stage_topk(spark, sf):
    best = V.two_stage(_best_cases(spark, sf), "query", "case_id", "sim", "planned", k=5, threshold=0.8)
    return best.select("query", "case_id", "stage", r6("sim").alias("sim"), "rank")


register("two_stage_topk", two_stage_topk, f"""WITH {CASES_SQL}, g AS (SELECT *, CASE WHEN sum(CASE WHEN planned AND sim >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY query) >= 3 THEN 1 ELSE 2 END AS stage FROM scored),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, case_id) AS rank FROM g WHERE stage = 2 OR planned) SELECT query, case_id, stage, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")


def kernel_confidence_abstain(spark, sf):
    best = R.top_k_per(_best_cases(spark, sf).where("sim > 0"), ["query"], [F.desc("sim"), F.col("case_id")], 5)
    out = V.predict(best, "query", "sim", "duration", least_eff=3.0, least_confidence=0.9)
    return out.select("query", "n", *[r6(c).alias(c) for c in ("n_eff", "weighted_mean", "weighted_median", "confidence", "best")], "abstain")


register("kernel_confidence_abstain", kernel_confidence_abstain, f"""WITH {CASES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, case_id) AS rank FROM scored WHERE sim > 0), t AS (SELECT * FROM k WHERE rank <= 5),
c AS (SELECT *, sum(sim) OVER (PARTITION BY query ORDER BY duration, sim ROWS UNBOUNDED PRECEDING) / sum(sim) OVER (PARTITION BY query) AS share FROM t),
p AS (SELECT query, count(*) AS n, sum(sim) ** 2 / sum(sim * sim) AS n_eff, sum(sim * duration) / sum(sim) AS weighted_mean, min(duration) FILTER (share >= 0.5 - 1e-9) AS weighted_median, least(1.0, count(*) / 3.0::DOUBLE) * avg(sim) AS confidence, max(sim) AS best FROM c GROUP BY query)
SELECT query, n, round(n_eff, 6) AS n_eff, round(weighted_mean, 6) AS weighted_mean, round(weighted_median, 6) AS weighted_median, round(confidence, 6) AS confidence, round(best, 6) AS best, n_eff < 3 OR confidence < 0.9 AS abstain FROM p""")


MEDOID_WEIGHTS = {"price": 0.4, "month": 0.2, "priority": 0.25, "event_cause": 0.15}


def _medoids(spark, sf, k=12):
    c = _cases(spark, sf)
    found, _ = K.find_medoids(c, "event_id", RANGES, MEDOID_WEIGHTS, k)
    return c, found


def gower_medoids(spark, sf):
    """Prototypes of the cases by k-medoids: support, median duration, share of planned cases and quality of each."""
    c, found = _medoids(spark, sf)
    near = K.nearest_medoids(c, "event_id", found, RANGES, MEDOID_WEIGHTS)
    out = near.groupBy(F.col("medoid").alias("prototype")).agg(
        F.count(F.lit(1)).alias("support"),
        F.median("duration").alias("median_duration"),
        r6(F.avg(F.col("planned").cast("double"))).alias("planned_rate"),
        r6(F.avg(F.exp(-F.col("distance") / 0.5))).alias("quality"),
        r6(F.sum("distance")).alias("cost"),
    )
    own = c.select(F.col("event_id").alias("prototype"), "priority", "event_cause", "price", "month")
    return out.join(own, "prototype")


def medoid_estimates(spark, sf):
    """For each query its five nearest prototypes but itself: expected duration, effective sample size, confidence
    and whether to abstain, by similarities e^(-2 distance)."""
    c, found = _medoids(spark, sf)
    medians = K.nearest_medoids(c, "event_id", found, RANGES, MEDOID_WEIGHTS).groupBy("medoid").agg(F.median("duration").alias("median_duration"))
    near = K.nearest_medoids(c.where("event_id % 20 = 0"), "event_id", found, RANGES, MEDOID_WEIGHTS, k=5, but_itself=True)
    sim = F.exp(-F.col("distance") / 0.5)
    rows = near.withColumn("sim", sim).join(F.broadcast(medians), "medoid")
    eff = F.sum("sim") * F.sum("sim") / F.sum(F.col("sim") * F.col("sim"))
    out = rows.groupBy(F.col("event_id").alias("query")).agg(F.max_by("medoid", F.struct(-F.col("place"))).alias("prototype"), eff.alias("n_eff"), F.avg("sim").alias("mean_sim"), F.max("sim").alias("best"), (F.sum(F.col("sim") * F.col("median_duration")) / F.sum("sim")).alias("expected"))
    confidence = F.col("n_eff") / (F.col("n_eff") + 2) * F.col("mean_sim") * F.col("best")
    reason = F.when(F.col("best") < 0.30, "best").when(F.col("n_eff") < 3.0, "n_eff").when(confidence < 0.40, "confidence").otherwise("sufficient")
    return out.select("query", "prototype", r6("n_eff").alias("n_eff"), r6("expected").alias("expected"), r6(confidence).alias("confidence"), reason.alias("evidence"), (reason != "sufficient").alias("abstain"))


for query in (gower_medoids, medoid_estimates):
    register(query.__name__, query)


def embedding_cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.cosine_topk(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


register("embedding_cosine_topk", embedding_cosine_topk, """
WITH s AS (SELECT q.vec_id AS query, c.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 6) AS cosine
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query, vec_id, cosine, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")

# --- allocation


def greedy_allocation(spark, sf):
    return A.allocate(_junctions(spark, sf), "junction", "burden", 300, 4).select("junction", "units")


register("greedy_allocation", greedy_allocation, f"""WITH {J}, s AS (SELECT junction, 300.0::DOUBLE * burden / sum(burden) OVER () AS share FROM junctions), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 300 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM b)
SELECT junction, CAST(base + CASE WHEN place <= leftover AND base < 4 THEN 1 ELSE 0 END AS INTEGER) AS units FROM p""")


def tiers_by_rank(spark, sf):
    return A.tiers(_junctions(spark, sf), [F.desc("burden"), F.col("junction")], {"critical": 0.08, "high": 0.12, "medium": 0.20}, "low").select("junction", "tier")


register("tiers_by_rank", tiers_by_rank, f"""WITH {J}, r AS (SELECT junction, row_number() OVER (ORDER BY burden DESC, junction) AS p, count(*) OVER () AS n FROM junctions)
SELECT junction, CASE WHEN p <= greatest(1, ceil(n * 0.08)) THEN 'critical' WHEN p <= greatest(1, ceil(n * 0.08)) + greatest(1, ceil(n * 0.12)) THEN 'high' WHEN p <= greatest(1, ceil(n * 0.08)) + greatest(1, ceil(n * 0.12)) + greatest(1, ceil(n * 0.20)) THEN 'medium' ELSE 'low' END AS tier FROM r""")


def cvar_levels(spark, sf):
    return A.tail_risk(I.clicks(spark, sf), ["event_cause"], "duration", (0.8, 0.9, 0.95)).select("event_cause", "alpha", "var", r6("cvar").alias("cvar"))


register("cvar_levels", cvar_levels, f"""WITH {I.CLICKS_SQL}, r AS (SELECT event_cause, duration, row_number() OVER (PARTITION BY event_cause ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY event_cause) AS n FROM clicks)
SELECT event_cause, alpha, min(duration) AS var, round(avg(duration), 6) AS cvar FROM r, (SELECT unnest([0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS alpha) WHERE i >= least(floor(alpha * n + 1e-9), n - 1) GROUP BY ALL""")

SCENARIOS = {"base": {}, "officers+2": {"officers": 2}, "tow+1": {"tow": 1}, "both": {"officers": 2, "tow": 1}}


def counterfactual_grid(spark, sf):
    sites = A.allocate(_junctions(spark, sf), "junction", "burden", 300, 4)
    effect = X.effectiveness([(F.col("units") + F.col("add_officers"), 0.18), (F.col("closure_rate") + F.col("add_tow"), 0.25)])
    out = A.what_if(sites, "junction", SCENARIOS, effect, ["officers", "tow"])
    return out.select("junction", "scenario", r6("effect").alias("effect"), r6("gain").alias("gain"), "best")


register("counterfactual_grid", counterfactual_grid, f"""WITH {J}, s AS (SELECT junction, closure_rate, 300.0::DOUBLE * burden / sum(burden) OVER () AS share FROM junctions), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 300 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM b), u AS (SELECT junction, closure_rate, base + CASE WHEN place <= leftover AND base < 4 THEN 1 ELSE 0 END AS units FROM p),
g(i, scenario, o, w) AS (VALUES (0, 'base', 0, 0), (1, 'officers+2', 2, 0), (2, 'tow+1', 0, 1), (3, 'both', 2, 1)), e AS (SELECT junction, i, scenario, least(0.9, 1 - exp(-((units + o) * 0.18::DOUBLE + (closure_rate + w) * 0.25::DOUBLE))) AS effect FROM u, g),
x AS (SELECT *, max(CASE WHEN scenario = 'base' THEN effect END) OVER (PARTITION BY junction) AS base FROM e), y AS (SELECT *, round((effect - base) / greatest(1 - base, 1e-9), 9) AS gain FROM x)
SELECT junction, scenario, round(effect, 6) AS effect, round(gain, 6) AS gain, row_number() OVER (PARTITION BY junction ORDER BY gain DESC, i) = 1 AND scenario <> 'base' AS best FROM y""")


def efficiency_grid(spark, sf):
    sites = _junctions(spark, sf)
    grid = sites.select("junction", "n").withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in (1.0, 1.25, 1.5, 1.75, 2.0)])))
    gain = 0.4 * (1 - F.exp(-0.08 * F.col("n") / 10 * F.col("multiplier")))
    out = grid.withColumn("gain", gain).withColumn("marginal", F.col("gain") - F.lag("gain").over(W.partitionBy("junction").orderBy("multiplier")))
    return out.groupBy("multiplier").agg(r6(F.avg("gain")).alias("gain"), r6(F.avg("marginal")).alias("marginal"))


register("efficiency_grid", efficiency_grid, f"""WITH {J}, g AS (SELECT junction, m AS multiplier, 0.4 * (1 - exp(-0.08 * n / 10 * m)) AS gain FROM junctions, (SELECT unnest([1.0::DOUBLE, 1.25::DOUBLE, 1.5::DOUBLE, 1.75::DOUBLE, 2.0::DOUBLE]) AS m)), l AS (SELECT *, gain - lag(gain) OVER (PARTITION BY junction ORDER BY multiplier) AS marginal FROM g)
SELECT multiplier, round(avg(gain), 6) AS gain, round(avg(marginal), 6) AS marginal FROM l GROUP BY multiplier""")


def knapsack_allocation(spark, sf):
    sites = _junctions(spark, sf).withColumn("tow", F.ceil(F.col("closure_rate") * 3).cast("double")).withColumn("officers", F.ceil(F.col("n") / 20).cast("double"))
    out = A.knapsack(sites, "junction", "burden", {"officers": "officers", "tow": "tow"}, {"officers": 120, "tow": 40})
    return out.select("junction", "officers", "tow", r6("fraction").alias("fraction"))


register("knapsack_allocation", knapsack_allocation, f"""WITH {J}, s AS (SELECT junction, burden, ceil(closure_rate * 3) AS tow, CAST(ceil(n / 20.0::DOUBLE) AS DOUBLE) AS officers FROM junctions),
c AS (SELECT *, sum(tow) OVER w - tow AS bt, sum(officers) OVER w - officers AS bo FROM s WINDOW w AS (ORDER BY burden DESC, junction ROWS UNBOUNDED PRECEDING))
SELECT junction, officers, tow, round(least(1.0, CASE WHEN officers > 0 THEN greatest(0.0, (120 - bo) / officers) ELSE 1 END, CASE WHEN tow > 0 THEN greatest(0.0, (40 - bt) / tow) ELSE 1 END), 6) AS fraction FROM c""")

# --- monitoring and indices


def retrain_triggers(spark, sf):
    c = I.clicks(spark, sf)
    z = c.groupBy("zone").agg(F.avg("duration").alias("mean"), F.avg("trust").alias("trust"), F.count(F.lit(1)).alias("n"))
    rules = [("drift", F.col("mean") > 10.05, "critical"), ("low_trust", F.col("trust") < 0.505, "moderate"), ("small", F.col("n") < 100, "info")]
    found = None
    for name, rule, severity in rules:
        part = z.where(rule).select("zone", F.lit(name).alias("trigger"), F.lit(severity).alias("severity"))
        found = part if found is None else found.unionByName(part)
    none = z.select("zone").join(found.select("zone"), "zone", "left_anti").select("zone", F.lit("NO_TRIGGERS").alias("trigger"), F.lit("none").alias("severity"))
    rank = X.lookup(F.col("severity"), {"info": 1, "moderate": 2, "critical": 3}, 0)
    return found.unionByName(none).withColumn("severity_rank", rank.cast("int")).orderBy(F.desc("severity_rank"), "zone", "trigger")


register("retrain_triggers", retrain_triggers, f"""WITH {I.CLICKS_SQL}, z AS (SELECT zone, avg(duration) AS mean, avg(trust) AS trust, count(*) AS n FROM clicks GROUP BY zone),
f AS (SELECT zone, 'drift' AS trigger, 'critical' AS severity, 3 AS severity_rank FROM z WHERE mean > 10.05 UNION ALL SELECT zone, 'low_trust', 'moderate', 2 FROM z WHERE trust < 0.505 UNION ALL SELECT zone, 'small', 'info', 1 FROM z WHERE n < 100)
SELECT * FROM f UNION ALL SELECT zone, 'NO_TRIGGERS', 'none', 0 FROM z WHERE zone NOT IN (SELECT zone FROM f)""")


def action_policy(spark, sf):
    j = _junctions(spark, sf)
    cuts = j.agg(F.percentile("burden", F.array(*[F.lit(q) for q in (0.25, 0.75, 0.9, 0.95)])).alias("q"))
    q = F.col("q")
    act = X.cases([(F.col("burden") >= q[3], "deploy"), (F.col("burden") >= q[2], "standby"), (F.col("burden") >= q[1], "monitor"), (F.col("burden") < q[0], "none")], "watch")
    return j.crossJoin(F.broadcast(cuts)).withColumn("action", act).groupBy("action").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("burden")).alias("burden"))


register("action_policy", action_policy, f"""WITH {J}, q AS (SELECT quantile_cont(burden, [0.25, 0.75, 0.9, 0.95]) AS q FROM junctions)
SELECT CASE WHEN burden >= q[4] THEN 'deploy' WHEN burden >= q[3] THEN 'standby' WHEN burden >= q[2] THEN 'monitor' WHEN burden < q[1] THEN 'none' ELSE 'watch' END AS action, count(*) AS n, round(sum(burden), 6) AS burden FROM junctions, q GROUP BY 1""")


def resilience_index(spark, sf):
    j = _junctions(spark, sf)
    base = j.agg(F.avg(F.col("mean_duration") / 20).alias("a"), F.avg("closure_rate").alias("b"), (F.stddev_pop("burden") / F.avg("burden")).alias("c"))
    variants = spark.createDataFrame([("default", 0.40, 0.35, 0.25), ("equal", 1 / 3, 1 / 3, 1 / 3), ("delay", 0.6, 0.2, 0.2), ("closure", 0.2, 0.6, 0.2), ("spread", 0.2, 0.2, 0.6)], "variant string, x double, y double, z double")
    loss = F.col("x") * X.clip(F.col("a"), 0, 1) + F.col("y") * X.clip(F.col("b"), 0, 1) + F.col("z") * X.clip(F.col("c"), 0, 1)
    score = 1 - loss
    return variants.crossJoin(F.broadcast(base)).select("variant", r6(score).alias("index"), X.cases([(score >= 0.8, "strong"), (score >= 0.65, "fair"), (score >= 0.5, "weak")], "fragile").alias("class"))


register("resilience_index", resilience_index, f"""WITH {J}, b AS (SELECT least(1.0, avg(mean_duration / 20)) AS a, least(1.0, avg(closure_rate)) AS b, least(1.0, stddev_pop(burden) / avg(burden)) AS c FROM junctions),
v(variant, x, y, z) AS (VALUES ('default', 0.40::DOUBLE, 0.35::DOUBLE, 0.25::DOUBLE), ('equal', 1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3), ('delay', 0.6, 0.2, 0.2), ('closure', 0.2, 0.6, 0.2), ('spread', 0.2, 0.2, 0.6)), s AS (SELECT variant, 1 - (x * a + y * b + z * c) AS score FROM v, b)
SELECT variant, round(score, 6) AS index, CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.65 THEN 'fair' WHEN score >= 0.5 THEN 'weak' ELSE 'fragile' END AS class FROM s""")


def tail_mixture(spark, sf):
    c = I.clicks(spark, sf)
    q = F.percentile("duration", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)))
    by_cause = c.groupBy("event_cause").agg(q.alias("q"), F.count_if(F.col("duration") > 25).alias("tail_n"), F.avg((F.col("duration") > 25).cast("double")).alias("tail_p"))
    tails = c.where("duration > 25").groupBy("event_cause").agg(F.percentile("duration", F.lit(0.5)).alias("proxy"))
    overall = c.where("duration > 25").agg(F.percentile("duration", F.lit(0.5)).alias("global_proxy"))
    rows = by_cause.join(tails, "event_cause", "left").crossJoin(F.broadcast(overall))
    proxy = F.when(F.col("tail_n") >= 10, F.col("proxy")).otherwise(F.col("global_proxy"))
    mixed = lambda i: (1 - F.col("tail_p")) * F.col("q")[i] + F.col("tail_p") * F.greatest(proxy, F.col("q")[i])
    return rows.select("event_cause", r6("tail_p").alias("tail_p"), r6(F.col("q")[0]).alias("p50"), r6(mixed(1)).alias("p80"), r6(mixed(2)).alias("p95"))


register("tail_mixture", tail_mixture, f"""WITH {I.CLICKS_SQL}, g AS (SELECT median(duration) AS gp FROM clicks WHERE duration > 25),
s AS (SELECT event_cause, quantile_cont(duration, [0.5, 0.8, 0.95]) AS q, count(*) FILTER (duration > 25) AS tn, avg(CASE WHEN duration > 25 THEN 1.0 ELSE 0.0 END) AS tp, median(duration) FILTER (duration > 25) AS px FROM clicks GROUP BY event_cause), m AS (SELECT *, CASE WHEN tn >= 10 THEN px ELSE gp END AS proxy FROM s, g)
SELECT event_cause, round(tp, 6) AS tail_p, round(q[1], 6) AS p50, round((1 - tp) * q[2] + tp * greatest(proxy, q[2]), 6) AS p80, round((1 - tp) * q[3] + tp * greatest(proxy, q[3]), 6) AS p95 FROM m""")


def worked_example(spark, sf):
    """One site's sections, each looked up by a key of its own, as one row."""
    j = _junctions(spark, sf)
    site = j.orderBy(F.desc("burden"), "junction").limit(1)
    zone = I.clicks(spark, sf).groupBy("zone").agg(F.count(F.lit(1)).alias("zone_n"), F.avg("duration").alias("zone_mean"))
    units = A.allocate(j, "junction", "burden", 300, 4).select("junction", "units")
    out = site.join(zone, "zone", "left").join(units, "junction", "left")
    doc = F.to_json(F.struct("junction", "zone", "units"))
    return out.select("junction", "zone", "n", "units", "zone_n", r6("zone_mean").alias("zone_mean"), doc.alias("document"))


register("worked_example", worked_example, f"""WITH {J}, s AS (SELECT junction, 300.0::DOUBLE * burden / sum(burden) OVER () AS share FROM junctions), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 300 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM b), u AS (SELECT junction, CAST(base + CASE WHEN place <= leftover AND base < 4 THEN 1 ELSE 0 END AS INTEGER) AS units FROM p),
z AS (SELECT zone, count(*) AS zone_n, avg(duration) AS zone_mean FROM clicks GROUP BY zone)
SELECT j.junction, j.zone, j.n, u.units, z.zone_n, round(z.zone_mean, 6) AS zone_mean, '{{"junction":' || j.junction || ',"zone":' || j.zone || ',"units":' || u.units || '}}' AS document FROM junctions j JOIN u USING (junction) JOIN z ON z.zone = j.zone ORDER BY j.burden DESC, j.junction LIMIT 1""")
