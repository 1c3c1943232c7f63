"""Queries: slices of hot spots, class matching, weights and demand, plan variants, re-ranking, audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import allocation as A
from siltstone.operators import incidents as I
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.operators import retrieval as V
from siltstone.operators import spatial as G
from siltstone.plans import q_space, q_time
from siltstone.plans.catalogue import SQL, register
from siltstone.plans.q_core import r6
from siltstone.sources.scratch import written
from siltstone.sources.tables import table

J = I.JUNCTIONS_SQL

# --- hot spots by hour and day of the week


def gi_star_by_hour_dow(spark, sf):
    """Slices of at least 50 events at 10 places; with 15 places those at the slice's 90 % quantile or above are hot."""
    c = I.clicks(spark, sf).withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")})
    by = ["hour", "dow"]
    places = c.groupBy(*by, "junction").agg(F.sum(F.col("trust") * F.log1p("duration")).alias("severity"), F.count(F.lit(1)).alias("events"))
    places = written(places, "slices").withColumns({"lat": 12 + (F.col("junction") * 7 % 31) * 0.01, "lon": 77 + (F.col("junction") * 11 % 37) * 0.01})
    size = places.groupBy(*by).agg(F.sum("events").alias("slice_events"), F.count(F.lit(1)).alias("places")).where("slice_events >= 50 and places >= 10")
    # each is read several times
    places = written(places.join(F.broadcast(size), by), "places")
    z = written(G.getis_ord(places, G.nearest_neighbours(places, "junction", 6, by=by), "junction", "severity", by).withColumn("z", r6("z")), "gi_star")
    cut = z.groupBy(*by).agg(F.percentile("z", F.lit(0.9)).alias("cut"), F.count(F.lit(1)).alias("places"))
    return z.join(F.broadcast(cut), by).select(*by, "junction", "z", ((F.col("places") >= 15) & (F.col("z") >= F.col("cut"))).alias("hot"))


register("gi_star_by_hour_dow", gi_star_by_hour_dow, f"""WITH {I.CLICKS_SQL}, p0 AS (SELECT hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS dow, junction, sum(trust * ln(1 + duration)) AS severity, count(*) AS events,
  12 + (junction * 7 % 31) * 0.01::DOUBLE AS lat, 77 + (junction * 11 % 37) * 0.01::DOUBLE AS lon FROM clicks GROUP BY 1, 2, 3),
p AS (SELECT * FROM p0 JOIN (SELECT hour, dow FROM p0 GROUP BY ALL HAVING sum(events) >= 50 AND count(*) >= 10) USING (hour, dow)),
pairs AS (SELECT a.hour, a.dow, a.junction, b.junction AS neighbour, row_number() OVER (PARTITION BY a.hour, a.dow, a.junction ORDER BY (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2, b.junction) AS k FROM p a JOIN p b ON a.hour = b.hour AND a.dow = b.dow AND a.junction <> b.junction),
w AS (SELECT hour, dow, junction, neighbour FROM pairs WHERE k <= 6 UNION ALL SELECT hour, dow, junction, junction FROM p),
l AS (SELECT w.hour, w.dow, w.junction, count(*) AS m, avg(p.severity) AS local FROM w JOIN p ON p.hour = w.hour AND p.dow = w.dow AND p.junction = w.neighbour GROUP BY ALL),
t AS (SELECT hour, dow, count(*) AS n, avg(severity) AS mean, stddev_pop(severity) AS sd FROM p GROUP BY ALL),
z AS (SELECT hour, dow, junction, n, round(CASE WHEN sd > 0 THEN (local - mean) / (sd * sqrt((n / m::DOUBLE - 1) / (n - 1))) ELSE 0 END, 6) AS z FROM l JOIN t USING (hour, dow)),
c AS (SELECT hour, dow, quantile_cont(z, 0.9) AS cut FROM z GROUP BY ALL)
SELECT CAST(hour AS INTEGER) AS hour, CAST(dow AS INTEGER) AS dow, junction, z, n >= 15 AND z >= cut AS hot FROM z JOIN c USING (hour, dow)""")


def chain_components(spark, sf):
    m = q_space._members(spark, sf)
    edges = G.chain_edges(m.where(F.col("node") % 7 != 0), "node", "corridor", [F.desc("w")])
    found = P.components(edges, "a", "b", m, "node")
    return found.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("component")))


register("chain_components", chain_components, """WITH RECURSIVE chain AS (SELECT a, b FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS b FROM supplier WHERE s_suppkey % 7 <> 0) WHERE b IS NOT NULL),
both_ways AS (SELECT a, b FROM chain UNION SELECT b, a FROM chain), r AS (SELECT s_suppkey AS node, s_suppkey AS other FROM supplier UNION SELECT r.node, c.b FROM r JOIN both_ways c ON r.other = c.a),
l AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM l""")

# --- classes, keywords, weights
CLASSES = ["ring", "gear box", "blue widget", "standard", "steel plate"]
CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def closest_part_class(spark, sf):
    values = table(spark, sf, "part").select(F.col("p_name").alias("value")).distinct()
    return values.select("value", P.closest_class(F.col("value"), CLASSES).alias("closest"))


register("closest_part_class", closest_part_class, rf"""WITH n AS (SELECT DISTINCT p_name AS value, lower(p_name) AS low FROM part)
SELECT value, coalesce(list_filter({CLASS_LIST}, lambda c: contains(c, low) OR contains(low, c))[1], flatten(list_transform(list_filter(string_split_regex(low, '\s+'), lambda w: w <> ''), lambda w: list_filter({CLASS_LIST}, lambda c: contains(c, w))))[1], 'ring') AS closest FROM n""")


def keyword_fallback(spark, sf):
    """Rows of a class, and rows found by keywords where the class has fewer than ten."""
    p = table(spark, sf, "part")
    words = F.col("p_name").rlike("ring|gear")
    some, none = (P.with_fallback(p, F.col("p_type") == kind, words).select(F.lit(kind).alias("wanted"), "p_partkey", "p_name", "p_type") for kind in ("ECONOMY", "PARADE"))
    return some.unionByName(none)


register("keyword_fallback", keyword_fallback, """WITH w AS (SELECT unnest(['ECONOMY', 'PARADE']) AS wanted), c AS (SELECT wanted, count(p_partkey) >= 10 AS enough FROM w LEFT JOIN part ON p_type = wanted GROUP BY wanted)
SELECT wanted, p_partkey, p_name, p_type FROM c JOIN part ON p_type = wanted OR (NOT enough AND regexp_matches(p_name, 'ring|gear'))""")


def aligned_dummies(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"), "s_nationkey")
    sides = []
    for rows in (s.where("s_nationkey < 15"), s.where("s_nationkey >= 10")):
        values = sorted(r[0] for r in rows.select("nation").distinct().collect())
        sides.append(P.dummies(rows, "nation", values, ["s_suppkey"]))
    both = P.aligned(*sides)
    names = [c for c in both.columns if "=" in c]
    sums = both.groupBy("is_train").agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    return sums.unpivot("is_train", [F.col(f"`{c}`") for c in names], "dummy", "n")


register("aligned_dummies", aligned_dummies, """WITH s AS (SELECT true AS is_train, s_nationkey AS k FROM supplier WHERE s_nationkey < 15 UNION ALL SELECT false, s_nationkey FROM supplier WHERE s_nationkey >= 10),
g AS (SELECT DISTINCT t.is_train, k.k FROM (SELECT DISTINCT is_train FROM s) t, (SELECT DISTINCT k FROM s) k)
SELECT g.is_train, 'nation=' || g.k AS dummy, count(s.k) AS n FROM g LEFT JOIN s ON s.is_train = g.is_train AND s.k = g.k GROUP BY ALL""")

#: The weights that four parts of the domain give priorities, and what they give others.
PRIORITY_MAPS = {"incident": ({"1-URGENT": 3.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "5-LOW": 1.0}, 1.0), "survival": ({"1-URGENT": 2.0, "2-HIGH": 2.0, "5-LOW": 1.0}, 1.0), "fragility": ({"1-URGENT": 3.0, "2-HIGH": 3.0, "5-LOW": 1.0}, 2.0), "mark": ({"1-URGENT": 1.0, "2-HIGH": 1.0, "5-LOW": 0.333}, 0.667)}


def priority_weights(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("priority", "n", *[X.lookup(F.col("priority"), m, d).alias(name) for name, (m, d) in PRIORITY_MAPS.items()])


register("priority_weights", priority_weights, "SELECT o_orderpriority AS priority, count(*) AS n, " + ", ".join("CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in m.items()) + f" ELSE {d}::DOUBLE END AS {name}" for name, (m, d) in PRIORITY_MAPS.items()) + " FROM orders GROUP BY 1")


def cleaned_balances(spark, sf):
    """The first positive of several values, non-finite ones as null, and segments compared without blanks and case."""
    c = table(spark, sf, "customer")
    ratio = F.when(F.col("c_nationkey") == 0, F.lit(float("inf"))).when(F.col("c_nationkey") == 1, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / F.col("c_nationkey"))
    same = F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment"))) == "building"
    return c.select("c_custkey", X.first_positive(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.lit(1.5)).alias("first_positive"), r6(X.finite(ratio)).alias("ratio"), same.alias("is_building"))


register("cleaned_balances", cleaned_balances, """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 0 THEN CAST(c_nationkey AS DOUBLE) ELSE 1.5::DOUBLE END AS first_positive,
  CASE WHEN c_nationkey > 1 THEN round(c_acctbal / c_nationkey, 6) END AS ratio, lower(c_mktsegment) = 'building' AS is_building FROM customer""")


def demand_by_junction(spark, sf):
    j = P.spans_of(I.junctions(I.clicks(spark, sf)), ["burden"])
    units = P.demand_units(F.round(F.col("burden_unit") * 100, 6), F.col("mean_duration"), F.col("closure_rate") > 0.2, F.col("closure_rate"))
    return j.select("junction", r6(units.pop("ods")).alias("ods"), *[c.alias(n) for n, c in units.items()])


register("demand_by_junction", demand_by_junction, f"""WITH {J}, d AS (SELECT *, round(100 * (burden - min(burden) OVER ()) / (max(burden) OVER () - min(burden) OVER ()), 6) AS dis FROM junctions),
o AS (SELECT *, dis * (1 + least(mean_duration, 360.0) / 120) * CASE WHEN closure_rate > 0.2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * (1 + closure_rate) AS ods FROM d), u AS (SELECT *, CAST(least(25, greatest(1, ceil(ods / 30))) AS INTEGER) AS officers FROM o)
SELECT junction, round(ods, 6) AS ods, officers, CAST(least(40, greatest(0, ceil(ods / 20))) AS INTEGER) AS barricades, CAST(least(5, greatest(0, ceil(ods / 80))) AS INTEGER) AS tow_units, CAST(ceil(officers / 6.0::DOUBLE) AS INTEGER) AS supervisors, CAST(ceil(officers / 4.0::DOUBLE) AS INTEGER) AS patrol_vehicles, CAST(dis >= 70 AS INTEGER) AS qru_units FROM u""")

IMPACT = {"mean_duration": 0.35, "closure_rate": 0.25, "burden": 0.2, "n": 0.1, "zone": 0.1}
SIGNALS = {"burden": 1.5, "closure_rate": 1.2, "n": 0.8, "mean_duration": 1.0}
UNIT = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / CAST(max({c}) OVER () - min({c}) OVER () AS DOUBLE) ELSE 0 END"


def impact_scores(spark, sf):
    j = P.spans_of(I.junctions(I.clicks(spark, sf)), list(IMPACT))
    score = F.round(100 * P.blended(IMPACT), 6)
    return j.select("junction", score.alias("impact"), X.cases([(score < 25, "Low"), (score < 50, "Moderate"), (score < 75, "High")], "Critical").alias("level"))


register("impact_scores", impact_scores, f"""WITH {J}, s AS (SELECT junction, round(100 * ({" + ".join(f"{w}::DOUBLE * {UNIT(c)}" for c, w in IMPACT.items())}), 6) AS impact FROM junctions)
SELECT junction, impact, CASE WHEN impact < 25 THEN 'Low' WHEN impact < 50 THEN 'Moderate' WHEN impact < 75 THEN 'High' ELSE 'Critical' END AS level FROM s""")


def site_weights(spark, sf):
    return P.sigmoid_weights(I.junctions(I.clicks(spark, sf)), SIGNALS).select("junction", r6("weight").alias("weight"))


register("site_weights", site_weights, f"""WITH {J}, s AS (SELECT junction, {" + ".join(f"{w}::DOUBLE * {UNIT(c)}" for c, w in SIGNALS.items())} AS raw FROM junctions)
SELECT junction, round(1 / (1 + exp(avg(raw) OVER () - raw)), 6) AS weight FROM s""")

# --- intervals and information


def conformal_intervals(spark, sf):
    """Coverage of later clicks by the earlier ones' means, less and plus a quantile of their residuals."""
    c = I.early(I.clicks(spark, sf), 0.75).select("event_cause", "duration", "early")
    means = c.where("early").groupBy("event_cause").agg(F.avg("duration").alias("predicted"))
    rows = c.join(F.broadcast(means), "event_cause")
    out = P.conformal(rows.where("early"), rows.where("not early"), "duration", "predicted")
    covered = F.avg(F.col("duration").between(F.col("low"), F.col("high")).cast("double"))
    return out.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), r6(F.first("half_width")).alias("half_width"), r6(covered).alias("coverage"))


register("conformal_intervals", conformal_intervals, f"""WITH {I.CLICKS_SQL}, e AS (SELECT event_cause, duration, {I.early_sql(0.75)} AS early FROM clicks), m AS (SELECT event_cause, avg(duration) AS predicted FROM e WHERE early GROUP BY 1),
r AS (SELECT e.*, predicted FROM e JOIN m USING (event_cause)), h AS (SELECT quantile_cont(abs(duration - predicted), 0.9) AS half_width FROM r WHERE early)
SELECT event_cause, count(*) AS n, round(any_value(half_width), 6) AS half_width, round(avg(CAST(duration BETWEEN predicted - half_width AND predicted + half_width AS DOUBLE)), 6) AS coverage FROM r, h WHERE NOT early GROUP BY 1""")


def divergence_by_cause(spark, sf):
    """How far a cause's later log durations have moved from the earlier ones, as normal distributions."""
    c = I.early(I.clicks(spark, sf), 0.75).withColumn("x", F.log1p("duration"))
    of = lambda f, when: f(F.when(when, F.col("x")))
    early = F.col("early")
    s = c.groupBy("event_cause").agg(of(F.avg, early).alias("m0"), of(F.stddev_pop, early).alias("s0"), of(F.avg, ~early).alias("m1"), of(F.stddev_pop, ~early).alias("s1"))
    return s.select("event_cause", r6(X.gaussian_entropy(F.col("s0"))).alias("entropy_before"), r6(X.gaussian_entropy(F.col("s1"))).alias("entropy_after"), r6(X.gaussian_kl(F.col("m1"), F.col("s1"), F.col("m0"), F.col("s0"))).alias("kl"))


register("divergence_by_cause", divergence_by_cause, f"""WITH {I.CLICKS_SQL}, e AS (SELECT event_cause, ln(1 + duration) AS x, {I.early_sql(0.75)} AS early FROM clicks),
s AS (SELECT event_cause, avg(x) FILTER (early) AS m0, stddev_pop(x) FILTER (early) AS s0, avg(x) FILTER (NOT early) AS m1, stddev_pop(x) FILTER (NOT early) AS s1 FROM e GROUP BY 1)
SELECT event_cause, round(0.5 * ln(2 * pi() * exp(1)) + ln(s0), 6) AS entropy_before, round(0.5 * ln(2 * pi() * exp(1)) + ln(s1), 6) AS entropy_after, round(greatest(0, least(1e6, ln(s0 / s1) + (s1 * s1 + (m1 - m0) ** 2) / (2 * s0 * s0) - 0.5)), 6) AS kl FROM s""")


def entropy_by_level(spark, sf):
    """Posterior entropy and the prior's influence, weighted by effective sample size: by cause, level, and in all."""
    h = q_time.hierarchical_posterior(spark, sf).withColumn("entropy", X.gaussian_entropy(F.sqrt("posterior_variance")))
    mean = lambda c: r6(F.sum(F.col("n_eff") * F.col(c)) / F.sum("n_eff")).alias(c)
    out = h.groupingSets([["event_cause"], ["level"], []], "event_cause", "level").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("strata"), mean("entropy"), mean("prior_influence"))
    kind = X.cases([(F.col("g") == 1, "cause"), (F.col("g") == 2, "level")], "all")
    return out.select(kind.alias("grouping"), F.coalesce("event_cause", "level", F.lit("all")).alias("name"), "strata", "entropy", "prior_influence")


register("entropy_by_level", entropy_by_level, f"""WITH h AS ({SQL["hierarchical_posterior"]}), e AS (SELECT *, 0.5 * ln(2 * pi() * exp(1)) + ln(sqrt(posterior_variance)) AS entropy FROM h)
SELECT CASE WHEN event_cause IS NOT NULL THEN 'cause' WHEN level IS NOT NULL THEN 'level' ELSE 'all' END AS grouping, coalesce(event_cause, level, 'all') AS name, count(*) AS strata, round(sum(n_eff * entropy) / sum(n_eff), 6) AS entropy, round(sum(n_eff * prior_influence) / sum(n_eff), 6) AS prior_influence
FROM e GROUP BY GROUPING SETS ((event_cause), (level), ())""")

# --- plans


def alternative_plans(spark, sf):
    j = I.junctions(I.clicks(spark, sf))
    units = A.allocate(j, "junction", "burden", 300, 4).select("junction", F.col("units").alias("officers"), (F.col("units") * 2).cast("int").alias("barricades"))
    return P.plan_variants(units, "junction", {"officers": 4, "barricades": 6}, {"officers": 300, "barricades": 500}, F.col("officers") >= 2, F.round(1 - F.exp(-0.5 * F.col("officers")), 6), j.count()).withColumn("effectiveness", r6("effectiveness"))


register("alternative_plans", alternative_plans, f"""WITH g AS ({SQL["greedy_allocation"]}), b AS (SELECT junction, units AS o, CAST(units * 2 AS INTEGER) AS b, units >= 2 AS critical, round(1 - exp(-0.5::DOUBLE * units), 6) AS e, count(*) OVER () AS n FROM g),
p AS (SELECT *, CASE WHEN critical THEN 1.3::DOUBLE ELSE 0.7::DOUBLE END AS f FROM b)
SELECT 'plan_A_optimal' AS plan, junction, CAST(o AS INTEGER) AS officers, b AS barricades, e AS effectiveness FROM p
UNION ALL SELECT 'plan_B_conservative', junction, CAST(least(4, floor(o * f + 1e-9)) AS INTEGER), CAST(least(6, floor(b * f + 1e-9)) AS INTEGER), round(e * CASE WHEN critical THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END, 6) FROM p
UNION ALL SELECT 'plan_C_spread', junction, CAST(least(4, greatest(1, 300 // n)) AS INTEGER), CAST(least(6, greatest(1, 500 // n)) AS INTEGER), 0.3::DOUBLE FROM p""")


def allocated_or_recommended(spark, sf):
    """Units given to the busiest places; others keep what is recommended, in full."""
    j = P.spans_of(I.junctions(I.clicks(spark, sf)), ["burden"]).withColumn("recommended", F.ceil(F.round(F.col("burden_unit") * 4, 6)).cast("int"))
    top = j.orderBy(F.desc("burden"), "junction").limit(100).select("junction", "burden")
    given = A.allocate(top, "junction", "burden", 120, 4).select("junction", "units")
    return j.join(F.broadcast(given), "junction", "left").select("junction", "recommended", F.coalesce("units", "recommended").cast("int").alias("units"), F.when(F.col("units").isNull(), 1.0).otherwise(r6(F.col("units") / F.greatest(F.lit(1), "recommended"))).alias("fraction"))


register("allocated_or_recommended", allocated_or_recommended, f"""WITH {J}, j AS (SELECT *, CAST(ceil(round(4 * ({UNIT("burden")}), 6)) AS INTEGER) AS recommended FROM junctions), t AS (SELECT junction, burden FROM j ORDER BY burden DESC, junction LIMIT 100),
s AS (SELECT *, 120.0::DOUBLE * burden / sum(burden) OVER () AS share FROM t), b AS (SELECT *, least(CAST(floor(share) AS BIGINT), 4) AS base FROM s),
p AS (SELECT *, 120 - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM b), u AS (SELECT junction, base + CASE WHEN place <= leftover AND base < 4 THEN 1 ELSE 0 END AS units FROM p)
SELECT j.junction, recommended, CAST(coalesce(units, recommended) AS INTEGER) AS units, CASE WHEN units IS NULL THEN 1.0::DOUBLE ELSE round(units / CAST(greatest(1, recommended) AS DOUBLE), 6) END AS fraction FROM j LEFT JOIN u ON j.junction = u.junction""")

# --- retrieval


def decayed_rerank(spark, sf):
    """The twenty most similar cases of each query, ranked again by similarity that halves in half a year."""
    c = q_space._cases(spark, sf)
    starts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderdate")
    last = starts.agg(F.max("o_orderdate").alias("last"))
    found = V.best_cases(c.where("event_id % 20 = 0"), c, "event_id", *q_space.SIMILARITY, "planned", "duration", k=20)
    top = R.top_k_per(found, ["query"], [F.desc("sim"), F.col("case_id")], 20).drop("rank").join(starts, "case_id").crossJoin(F.broadcast(last))
    out = P.decayed_rank(top, "query", "case_id", "sim", F.datediff("last", "o_orderdate").cast("double"))
    return out.where("rank <= 5").select("query", "case_id", "rank", "rose", r6("decayed").alias("decayed"))


register("decayed_rerank", decayed_rerank, f"""WITH {q_space.CASES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, case_id) AS before FROM scored), d AS (SELECT query, case_id, before, sim * exp(-0.6931471805599453::DOUBLE * greatest(0, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders))) / 180.0::DOUBLE) AS decayed FROM k JOIN orders ON o_orderkey = case_id WHERE before <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(decayed, 9) DESC, case_id) AS rank FROM d) SELECT query, case_id, CAST(rank AS INTEGER) AS rank, CAST(before - rank AS INTEGER) AS rose, round(decayed, 6) AS decayed FROM r WHERE rank <= 5""")


def best_case_drivers(spark, sf):
    """What makes each query's best case alike: the three features that add most, and how much."""
    c = q_space._cases(spark, sf)
    best = R.top_k_per(q_space._best_cases(spark, sf), ["query"], [F.desc("sim"), F.col("case_id")], 1)
    side = lambda name, key: c.select(F.col("event_id").alias(key), F.struct("price", "month", "priority", "event_cause").alias(name))
    both = best.join(side("q", "query"), "query").join(side("c", "case_id"), "case_id")
    ranges, weights = q_space.RANGES, q_space.WEIGHTS
    alike = {f: 1 - F.least(F.lit(1.0), F.abs(F.col(f"q.{f}") - F.col(f"c.{f}")) / ranges[f]) if f in ranges else (F.col(f"q.{f}") == F.col(f"c.{f}")).cast("double") for f in weights}
    parts = F.array(*[F.struct((-F.round(weights[f] * a, 9)).alias("minus"), F.lit(f).alias("feature")) for f, a in alike.items()])
    top = F.slice(F.array_sort(parts), 1, 3)
    return both.select("query", "case_id", F.array_join(F.transform(top, lambda t: t["feature"]), "|").alias("drivers"), r6(-F.aggregate(top, F.lit(0.0), lambda s, t: s + t["minus"])).alias("explained"))


register("best_case_drivers", best_case_drivers, f"""WITH {q_space.CASES_SQL}, k AS (SELECT query, case_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, case_id) AS rank FROM scored) WHERE rank = 1),
p AS (SELECT k.*, unnest(['price', 'month', 'priority', 'event_cause']) AS feature, unnest([round(0.4::DOUBLE * (1 - least(1.0, abs(q.price - c.price) / 500000.0::DOUBLE)), 9), round(0.2::DOUBLE * (1 - least(1.0, abs(q.month - c.month) / 11.0::DOUBLE)), 9), 0.25::DOUBLE * CAST(q.priority = c.priority AS INTEGER), 0.15::DOUBLE * CAST(q.event_cause = c.event_cause AS INTEGER)]) AS part
  FROM k JOIN cases q ON q.event_id = query JOIN cases c ON c.event_id = case_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY part DESC, feature) AS place FROM p)
SELECT query, case_id, string_agg(feature, '|' ORDER BY place) AS drivers, round(sum(part), 6) AS explained FROM r WHERE place <= 3 GROUP BY ALL""")


def prototype_use(spark, sf):
    """The dearest case of each cause and priority is its prototype: how often it is among a case's one or five nearest."""
    c = q_space._cases(spark, sf)
    fields = F.struct(F.col("event_id"), "price", "month", "priority", "event_cause")
    protos = c.groupBy("event_cause", "priority").agg(F.min_by(fields, F.struct(-F.col("price"), F.col("event_id"))).alias("p"))
    every = protos.agg(F.collect_list("p").alias("prototypes"))  # one for each cause and priority
    ranges, w = q_space.RANGES, q_space.WEIGHTS
    far = lambda p: w["price"] * F.least(F.lit(1.0), F.abs(F.col("price") - p["price"]) / ranges["price"]) + w["month"] * F.least(F.lit(1.0), F.abs(F.col("month") - p["month"]) / ranges["month"]) + w["priority"] * (F.col("priority") != p["priority"]).cast("double") + w["event_cause"] * (F.col("event_cause") != p["event_cause"]).cast("double")
    others = F.filter("prototypes", lambda p: p["event_id"] != F.col("event_id"))
    near = F.slice(F.array_sort(F.transform(others, lambda p: F.struct(F.round(far(p), 9).alias("d"), p["event_id"].alias("prototype")))), 1, 5)
    hits = c.crossJoin(F.broadcast(every)).select(F.posexplode(near).alias("place", "hit"))
    return hits.groupBy(F.col("hit.prototype").alias("prototype")).agg(F.count_if(F.col("place") == 0).alias("top1"), F.count(F.lit(1)).alias("top5"))


register("prototype_use", prototype_use, f"""WITH {q_space.CASES_SQL}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_cause, priority ORDER BY price DESC, event_id) AS place FROM cases) WHERE place = 1),
d AS (SELECT c.event_id, p.event_id AS prototype, round(0.4::DOUBLE * least(1.0, abs(c.price - p.price) / 500000.0::DOUBLE) + 0.2::DOUBLE * least(1.0, abs(c.month - p.month) / 11.0::DOUBLE) + 0.25::DOUBLE * CAST(c.priority <> p.priority AS INTEGER) + 0.15::DOUBLE * CAST(c.event_cause <> p.event_cause AS INTEGER), 9) AS d FROM cases c JOIN p ON c.event_id <> p.event_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, prototype) AS place FROM d) SELECT prototype, count(*) FILTER (place = 1) AS top1, count(*) AS top5 FROM r WHERE place <= 5 GROUP BY 1""")

# --- audits
USED = ["event_cause", "priority", "past_count", "end_ts", "closure"]


def feature_leaks(spark, sf):
    """Which columns of an incident are known only after it began, from the times in the tables themselves."""
    rows = I.shipments(spark, sf)
    start, end, day = F.col("start_ts"), F.col("end_ts"), F.date_trunc("day", "start_ts")
    known = {"event_cause": start, "priority": start, "price": start, "corridor": start, "past_count": F.date_sub(day, 1), "duration": end, "end_ts": end, "closure": end, "junction": F.when(F.col("junction").isNotNull(), end)}
    return P.leaks(rows, known, start, USED)


register("feature_leaks", feature_leaks, f"""WITH {I.SHIPMENTS_SQL}, k AS (
  SELECT start_ts, unnest(['event_cause', 'priority', 'price', 'corridor', 'past_count', 'duration', 'end_ts', 'closure', 'junction']) AS feature,
         unnest([start_ts, start_ts, start_ts, start_ts, date_trunc('day', start_ts) - INTERVAL 1 DAY, end_ts, end_ts, end_ts, CASE WHEN junction IS NOT NULL THEN end_ts END]) AS known FROM shipments),
a AS (SELECT feature, count(known) AS n, count(*) FILTER (known > start_ts) AS late, CAST(greatest(0, coalesce(max(date_diff('day', start_ts, known)), 0)) AS INTEGER) AS longest_delay FROM k GROUP BY feature)
SELECT *, CASE WHEN feature NOT IN ({", ".join(f"'{u}'" for u in USED)}) THEN 'unused' WHEN late > 0 THEN 'leak' ELSE 'ok' END AS verdict FROM a""")


def consistency_checks(spark, sf):
    """Invariants between tables and how many rows break each."""
    o, c, li, n = (table(spark, sf, t) for t in ("orders", "customer", "lineitem", "nation"))
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("invariant"), "failures", (F.col("failures") == 0).alias("holds"))
    checks = [
        counted("order has customer", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        counted("line has order", li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        counted("customer has nation", c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
        counted("order keys are unique", o.groupBy("o_orderkey").count().where("count > 1")),
        counted("price is positive", o.where(~(F.col("o_totalprice") > 0))),
        counted("order has lines", o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        counted("line ships after its order", li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


register("consistency_checks", consistency_checks, """WITH f AS (
SELECT 'order has customer' AS invariant, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS failures UNION ALL SELECT 'line has order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'customer has nation', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'order keys are unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'price is positive', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 0) UNION ALL SELECT 'order has lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'line ships after its order', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)) SELECT invariant, failures, failures = 0 AS holds FROM f""")
