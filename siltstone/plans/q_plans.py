"""Queries: shares under several budgets, plans held against scenarios, and roles of zones in their network."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import budgets as B
from siltstone.operators import incidents as I
from siltstone.operators import relational as R
from siltstone.operators import spatial as G
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6
from siltstone.plans.q_space import FLOW_SQL, _flows

NEEDS = {"officers": "officers", "tow": "tow", "barricades": "barricades", "patrol": "patrol"}
WEEK = 7 * 86_400_000_000


def _sites(spark, sf):
    """Junctions with what they need of four resources, and budgets for about a third of each."""
    s = I.junctions(I.clicks(spark, sf)).withColumns({"officers": F.ceil(F.col("n") / 20).cast("double"), "tow": F.ceil(F.col("closure_rate") * 3).cast("double"), "barricades": F.floor(F.col("mean_duration") / 10), "patrol": (1 + F.col("junction") % 3).cast("double")})
    total = s.agg(*[F.sum(c).alias(k) for k, c in NEEDS.items()]).first()
    return s, {k: round((total[k] or 0.0) * share) for k, share in zip(NEEDS, (0.3, 0.4, 0.35, 0.5), strict=True)}


def budget_shares(spark, sf):
    """Each junction's share under four budgets, by burden; within half a percent of the best value."""
    sites, budgets = _sites(spark, sf)
    out, _ = B.fractional_knapsack(sites, "burden", NEEDS, budgets)
    return out.select("junction", "burden", *NEEDS, r6("fraction").alias("fraction"))


def budget_prices(spark, sf):
    """What one unit more of each resource would be worth, how much of it is used, and the proven gap to the best value."""
    sites, budgets = _sites(spark, sf)
    _, said = B.fractional_knapsack(sites, "burden", NEEDS, budgets)
    rows = [(k, float(budgets[k]), said["used"][k], said["prices"][k], said["value"], said["bound"], said["gap"]) for k in NEEDS]
    return spark.createDataFrame(rows, "resource string, budget double, used double, price double, value double, bound double, gap double")


for query in (budget_shares, budget_prices):
    register(query.__name__, query)


def _outcomes(spark, sf):
    """Every plan (0 to 4 officers, 0 to 2 tow trucks a junction) in every week at every junction: the delay that is left."""
    burden = I.clicks(spark, sf).groupBy("junction", F.floor(F.col("t") / WEEK).alias("week")).agg(F.sum(F.col("trust") * F.log1p("duration")).alias("load"))
    usual = burden.groupBy("junction").agg(F.avg("load").alias("usual"))
    plans = spark.range(15).select((F.col("id") % 5).cast("int").alias("officers"), F.floor(F.col("id") / 5).cast("int").alias("tow"))
    rows = burden.join(usual, "junction").crossJoin(F.broadcast(plans))
    return rows.withColumn("delay", F.round(F.col("load") * F.exp(-(0.08 * F.col("officers") + 0.15 * F.col("tow"))), 9))


def _plans(spark, sf):
    sites = B.chance_table(_outcomes(spark, sf), ["officers", "tow", "junction"], F.col("delay") <= F.col("usual"), F.col("delay"))
    ok = F.round("satisfied", 9) >= 0.8
    out = sites.groupBy("officers", "tow").agg(F.count(F.lit(1)).alias("sites"), F.count_if(ok).alias("sites_ok"), r6(F.avg("satisfied")).alias("satisfied"), r6(F.sum("cvar")).alias("cvar"))
    return out.withColumn("cost", (F.col("officers") * F.col("sites") + 2 * F.col("tow") * F.col("sites")).cast("long"))


OUTCOMES_SQL = f"""{I.CLICKS_SQL}, burden AS (SELECT junction, t // {WEEK} AS week, sum(trust * ln(1 + duration)) AS load FROM clicks GROUP BY ALL), usual AS (SELECT junction, avg(load) AS usual FROM burden GROUP BY junction),
plans AS (SELECT CAST(i % 5 AS INTEGER) AS officers, CAST(i // 5 AS INTEGER) AS tow FROM range(15) r(i)),
outcomes AS (SELECT officers, tow, junction, usual, round(load * exp(-(0.08::DOUBLE * officers + 0.15::DOUBLE * tow)), 9) AS delay FROM burden JOIN usual USING (junction), plans),
placed AS (SELECT *, row_number() OVER (PARTITION BY officers, tow, junction ORDER BY delay) - 1 AS place, count(*) OVER (PARTITION BY officers, tow, junction) AS n FROM outcomes),
sites AS (SELECT officers, tow, junction, avg(CASE WHEN delay <= usual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS satisfied, avg(delay) FILTER (place >= least(CAST(floor(0.9 * n + 1e-9) AS BIGINT), n - 1)) AS cvar FROM placed GROUP BY ALL),
rated AS (SELECT officers, tow, count(*) AS sites, count(*) FILTER (round(satisfied, 9) >= 0.8) AS sites_ok, round(avg(satisfied), 6) AS satisfied, round(sum(cvar), 6) AS cvar, CAST(count(*) * (officers + 2 * tow) AS BIGINT) AS cost FROM sites GROUP BY officers, tow)"""


def chance_constraints(spark, sf):
    """Each plan's cost, the junctions that it keeps at their usual load in four of five weeks, and its tail delay."""
    return _plans(spark, sf)


register("chance_constraints", chance_constraints, f"WITH {OUTCOMES_SQL} SELECT * FROM rated")


def pareto_plans(spark, sf):
    """The plans that no other beats in cost and in tail delay."""
    plans = _plans(spark, sf).withColumn("gain", -F.col("cvar"))
    return B.pareto_front(plans, "cost", "gain").drop("gain")


register("pareto_plans", pareto_plans, f"""WITH {OUTCOMES_SQL} SELECT * FROM rated a WHERE NOT EXISTS (SELECT 1 FROM rated b WHERE b.cost <= a.cost AND b.cvar <= a.cvar AND (b.cost < a.cost OR b.cvar < a.cvar))""")

# --- roles in the network of flows
USUAL = "weight >= 0.9 * usual"


def _links(spark, sf):
    """Flows between different corridors that are about as strong as the mean flow or stronger."""
    f = _flows(spark, sf)
    return f.crossJoin(F.broadcast(f.agg(F.avg("weight").alias("usual")))).where(f"a <> b AND {USUAL}").drop("usual")


LINKS_SQL = f"{FLOW_SQL}, link AS (SELECT a, b, weight FROM flow, (SELECT avg(weight) AS usual FROM flow) WHERE a <> b AND {USUAL})"
BETWEEN_SQL = """
reach AS (SELECT a AS source, a AS node, 0 AS hops FROM (SELECT a FROM link UNION SELECT b FROM link) UNION SELECT r.source, l.b, r.hops + 1 FROM reach r JOIN link l ON l.a = r.node WHERE r.hops < 10),
far AS (SELECT source, node, min(hops) AS hops FROM reach GROUP BY ALL),
walk AS (SELECT source, node, hops FROM far WHERE hops = 0 UNION ALL SELECT w.source, f.node, f.hops FROM walk w JOIN link l ON l.a = w.node JOIN far f ON f.source = w.source AND f.node = l.b AND f.hops = w.hops + 1),
ways AS (SELECT source, node, hops, CAST(count(*) AS DOUBLE) AS ways FROM walk GROUP BY ALL),
size AS (SELECT count(DISTINCT source) AS n FROM far),
between AS (
  SELECT f.node, coalesce(sum(x.ways * y.ways / st.ways), 0) / greatest(1, any_value((n - 1) * (n - 2))) AS betweenness
  FROM (SELECT DISTINCT node FROM far) f CROSS JOIN size LEFT JOIN ways x ON x.node = f.node AND x.source <> f.node LEFT JOIN ways y ON y.source = f.node AND y.node <> f.node AND y.node <> x.source
  LEFT JOIN ways st ON st.source = x.source AND st.node = y.node AND st.hops = x.hops + y.hops GROUP BY f.node)"""


def flow_betweenness(spark, sf):
    return G.betweenness(_links(spark, sf)).select("node", r6("betweenness").alias("betweenness"))


register("flow_betweenness", flow_betweenness, f"WITH RECURSIVE {LINKS_SQL}, {BETWEEN_SQL} SELECT node, round(betweenness, 6) AS betweenness FROM between")


def hub_roles(spark, sf):
    """Page rank, betweenness and eigenvector centrality from 0 to 1, the score of all three, and each corridor's role."""
    links = _links(spark, sf)
    both = G.pagerank(links, rounds=16).withColumnRenamed("rank", "pagerank").join(G.betweenness(links), "node").join(G.eigenvector(links), "node")
    scaled = both.select("node", *[R.min_max(c, 0.0).alias(c) for c in ("pagerank", "betweenness", "eigenvector")])
    pr, bc, ec = (F.round(c, 9) for c in ("pagerank", "betweenness", "eigenvector"))
    out = scaled.withColumn("hub_score", F.round(0.40 * F.col("pagerank") + 0.35 * F.col("betweenness") + 0.25 * F.col("eigenvector"), 9))
    role = X.cases([(F.col("hub_score") >= 0.7, "critical_hub"), ((pr >= 0.6) & (bc < 0.3), "sink"), ((bc >= 0.6) & (pr < 0.4), "relay"), (ec >= 0.6, "influential"), (F.col("hub_score") <= 0.2, "isolated")], "moderate")
    return out.select("node", *[r6(c).alias(c) for c in ("pagerank", "betweenness", "eigenvector", "hub_score")], role.alias("role"))


register("hub_roles", hub_roles)
