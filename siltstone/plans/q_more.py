"""Queries: joins and reports that the other modules leave, scenarios, indices and proportional hazards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import incidents as I
from siltstone.operators import scenarios as C
from siltstone.operators import survival as S
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import SURV_SQL, r6
from siltstone.sources.tables import table

J = I.JUNCTIONS_SQL


def combine_first(spark, sf):
    """A left value wins over the right one; rows of the left alone stay."""
    j = I.junctions(I.clicks(spark, sf)).select("junction", F.when(F.col("n") > 60, F.col("mean_duration")).alias("value"))
    other = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("junction"), (F.col("s_acctbal") / 100).alias("other"))
    return j.join(other, "junction", "left").select("junction", r6(F.coalesce("value", "other")).alias("value"), F.when(F.col("value").isNotNull(), "left").when(F.col("other").isNotNull(), "right").otherwise("none").alias("source"))


register("combine_first", combine_first, f"""WITH {J}, l AS (SELECT junction, CASE WHEN n > 60 THEN mean_duration END AS value FROM junctions)
SELECT l.junction, round(coalesce(value, s_acctbal / 100), 6) AS value, CASE WHEN value IS NOT NULL THEN 'left' WHEN s_acctbal IS NOT NULL THEN 'right' ELSE 'none' END AS source FROM l LEFT JOIN supplier ON s_suppkey = l.junction""")


def bridge_join(spark, sf):
    """Group means of a measure of parts, brought to nations through the distinct pairs of a many-to-many map."""
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    out = pairs.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return out.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("p_retailprice")).alias("mean_price"))


register("bridge_join", bridge_join, "SELECT s_nationkey, count(*) AS pairs, round(avg(p_retailprice), 6) AS mean_price FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_nationkey")


def semi_anti_union(spark, sf):
    """Customers with orders, without orders, and both together with missing columns as null."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("has"))
    none = c.join(o, "c_custkey", "left_anti").drop("c_mktsegment").withColumn("kind", F.lit("none"))
    return has.unionByName(none, allowMissingColumns=True).groupBy("kind", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


register("semi_anti_union", semi_anti_union, """
SELECT 'has' AS kind, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 2 UNION ALL SELECT 'none', NULL, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0""")


def modes_and_value_counts(spark, sf):
    s = I.shipments(spark, sf)
    counts = s.groupBy("corridor", "priority").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("r", F.row_number().over(W.partitionBy("corridor").orderBy(F.desc("n"), "priority"))).where("r = 1")
    return first.select("corridor", F.col("priority").alias("mode"), "n").join(s.groupBy("corridor").agg(F.count_distinct("event_cause").alias("causes"), r6(F.avg((F.hour("start_ts") < 12).cast("double"))).alias("morning")), "corridor")


register("modes_and_value_counts", modes_and_value_counts, f"""WITH {I.SHIPMENTS_SQL}, c0 AS (SELECT corridor, priority, count(*) AS n FROM shipments GROUP BY corridor, priority), c AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY n DESC, priority) AS r FROM c0),
m AS (SELECT corridor, count(DISTINCT event_cause) AS causes, round(avg(CASE WHEN hour(start_ts) < 12 THEN 1.0 ELSE 0.0 END), 6) AS morning FROM shipments GROUP BY corridor) SELECT corridor, priority AS mode, n, causes, morning FROM c JOIN m USING (corridor) WHERE r = 1""")


def train_window_marks(spark, sf):
    """Marks scaled by the training window's extremes and clipped to 0 and 1."""
    c = I.early(I.clicks(spark, sf), 0.7)
    raw = 0.4 * F.col("trust") + 0.3 * F.col("closure").cast("int") + 0.3 * F.log1p("duration")
    rows = c.withColumn("raw", raw).withColumn("train", F.col("early"))
    e = rows.agg(F.min(F.when(F.col("train"), F.col("raw"))).alias("low"), F.max(F.when(F.col("train"), F.col("raw"))).alias("high"))
    mark = F.when(F.col("high") > F.col("low"), X.clip((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")), 0.0, 1.0)).otherwise(0.5)
    return rows.crossJoin(F.broadcast(e)).withColumn("mark", mark).groupBy("zone", "train").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mark")).alias("mark"))


register("train_window_marks", train_window_marks, f"""WITH {I.CLICKS_SQL}, r AS (SELECT *, 0.4::DOUBLE * trust + 0.3::DOUBLE * CAST(closure AS INTEGER) + 0.3::DOUBLE * ln(1 + duration) AS raw, {I.early_sql(0.7)} AS train FROM clicks), e AS (SELECT min(raw) FILTER (train) AS low, max(raw) FILTER (train) AS high FROM r)
SELECT zone, train, count(*) AS n, round(avg(greatest(0.0, least(1.0, (raw - low) / (high - low)))), 6) AS mark FROM r, e GROUP BY ALL""")


def burden_with_missing_parts(spark, sf):
    j = I.junctions(I.clicks(spark, sf)).select("junction", (F.col("mean_duration") / 20).alias("a"), F.when(F.col("junction") % 3 != 0, F.col("closure_rate")).alias("b"), F.when(F.col("junction") % 4 != 0, F.col("n") / 100).alias("c"))
    j = j.withColumn("score", C.renormalised({"a": 0.5, "b": 0.3, "c": 0.2}))
    q = j.agg(F.percentile("score", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95))).alias("q"))
    tier = X.cases([(F.col("score") >= F.col("q")[2], "severe"), (F.col("score") >= F.col("q")[1], "high"), (F.col("score") >= F.col("q")[0], "medium")], "low")
    return j.crossJoin(F.broadcast(q)).select("junction", r6("score").alias("score"), tier.alias("tier"))


register("burden_with_missing_parts", burden_with_missing_parts, f"""WITH {J}, p AS (SELECT junction, mean_duration / 20 AS a, CASE WHEN junction % 3 <> 0 THEN closure_rate END AS b, CASE WHEN junction % 4 <> 0 THEN n / 100.0::DOUBLE END AS c FROM junctions),
s AS (SELECT junction, (0.5::DOUBLE * a + 0.3::DOUBLE * coalesce(b, 0) + 0.2::DOUBLE * coalesce(c, 0)) / (0.5::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.2::DOUBLE END) AS score FROM p), q AS (SELECT quantile_cont(score, [0.5, 0.8, 0.95]) AS q FROM s)
SELECT junction, round(score, 6) AS score, CASE WHEN score >= q[3] THEN 'severe' WHEN score >= q[2] THEN 'high' WHEN score >= q[1] THEN 'medium' ELSE 'low' END AS tier FROM s, q""")


def rank_changes(spark, sf):
    j = I.junctions(I.clicks(spark, sf))
    return C.rank_change(j, "junction", "n", "burden").where("moved > 0")


register("rank_changes", rank_changes, f"""WITH {J}, r AS (SELECT junction, row_number() OVER (ORDER BY n DESC, junction) AS rank_before, row_number() OVER (ORDER BY burden DESC, junction) AS rank_after FROM junctions)
SELECT junction, CAST(rank_before AS INTEGER) AS rank_before, CAST(rank_after AS INTEGER) AS rank_after, CAST(abs(rank_before - rank_after) AS INTEGER) AS moved FROM r WHERE rank_before <> rank_after""")


def prototype_trust(spark, sf):
    c = I.early(I.clicks(spark, sf), 0.8)
    prior = c.groupBy("event_cause", "corridor").agg(F.avg("trust").alias("trust"))
    outcomes = c.where("not early").withColumn("success", X.cases([(F.col("duration") < 5, 1.0), (F.col("duration") < 15, 0.5)], 0.0))
    out = C.updated_trust(prior, outcomes, ["event_cause", "corridor"])
    return out.select("event_cause", "corridor", r6("trust").alias("trust"), "n_outcomes")


register("prototype_trust", prototype_trust, f"""WITH {I.CLICKS_SQL}, p AS (SELECT event_cause, corridor, avg(trust) AS trust FROM clicks GROUP BY ALL), o AS (SELECT event_cause, corridor, avg(CASE WHEN duration < 5 THEN 1.0 WHEN duration < 15 THEN 0.5 ELSE 0.0 END) AS seen, count(*) AS n FROM clicks WHERE NOT {I.early_sql(0.8)} GROUP BY ALL)
SELECT p.event_cause, p.corridor, round(CASE WHEN seen IS NULL THEN trust ELSE 0.8::DOUBLE * trust + 0.2::DOUBLE * seen END, 6) AS trust, coalesce(n, 0) AS n_outcomes FROM p LEFT JOIN o ON p.event_cause = o.event_cause AND p.corridor = o.corridor""")


def zone_risk_index(spark, sf):
    c = I.clicks(spark, sf)
    out = C.risk_index(c, "zone", F.col("trust"), F.col("duration") / 60, F.col("closure").cast("double") / 2)
    return out.select("zone", *[r6(x).alias(x) for x in ("index", "low", "high")])


register("zone_risk_index", zone_risk_index, f"""WITH {I.CLICKS_SQL}, v AS (SELECT zone, trust * greatest(duration / 60, 0.05) * (1 + CAST(closure AS DOUBLE) / 2) AS v FROM clicks), s AS (SELECT zone, avg(v) AS m, stddev_pop(v) AS sd FROM v GROUP BY zone)
SELECT zone, round(m, 6) AS index, round(greatest(0.0, m - 1.96 * sd), 6) AS low, round(m + 1.96 * sd, 6) AS high FROM s""")


def budget_sensitivity(spark, sf):
    out = C.budget_sensitivity(I.junctions(I.clicks(spark, sf)), "junction", "burden", (100, 200, 300, 400), 6)
    return out.select("budget", "used", r6("effect").alias("effect"), r6("shadow_price").alias("shadow_price"))


register("budget_sensitivity", budget_sensitivity, f"""WITH {J}, g AS (SELECT junction, burden, b AS budget, b * burden / sum(burden) OVER (PARTITION BY b) AS share FROM junctions, (SELECT unnest([100, 200, 300, 400]) AS b)), f AS (SELECT *, least(CAST(floor(share) AS BIGINT), 6) AS base FROM g),
p AS (SELECT *, budget - sum(base) OVER (PARTITION BY budget) AS leftover, row_number() OVER (PARTITION BY budget ORDER BY round(share - floor(share), 9) DESC, junction) AS place FROM f), u AS (SELECT *, base + CASE WHEN place <= leftover AND base < 6 THEN 1 ELSE 0 END AS units FROM p),
e AS (SELECT budget, CAST(sum(units) AS BIGINT) AS used, sum(burden * (1 - exp(-0.18 * units))) / sum(burden) AS effect FROM u GROUP BY budget)
SELECT budget, used, round(effect, 6) AS effect, round((effect - lag(effect) OVER (ORDER BY budget)) / (budget - lag(budget) OVER (ORDER BY budget)), 6) AS shadow_price FROM e""")


def feature_weights_by_correlation(spark, sf):
    """Weights by absolute correlation with the outcome, shrunk by sample size and normalised."""
    c = I.clicks(spark, sf).withColumns({"closure_n": F.col("closure").cast("double"), "hour": F.hour("ts").cast("double")})
    names = ["k", "closure_n", "hour", "trust"]
    row = c.agg(F.count(F.lit(1)).alias("n"), *[F.abs(F.corr(x, "duration")).alias(x) for x in names])
    long = row.select((F.col("n") / (F.col("n") + 10)).alias("shrink"), F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.coalesce(F.col(x), F.lit(0.0)).alias("r")) for x in names])).alias("s"))
    total = F.sum("s.r").over(W.partitionBy())
    return long.select("s.feature", r6(F.col("s.r") * F.col("shrink")).alias("strength"), r6(F.col("s.r") / total).alias("weight"))


register("feature_weights_by_correlation", feature_weights_by_correlation, f"""WITH {I.CLICKS_SQL}, r AS (SELECT count(*) AS n, abs(corr(k, duration)) AS k, abs(corr(CAST(closure AS DOUBLE), duration)) AS closure_n, abs(corr(hour(ts), duration)) AS hour, abs(corr(trust, duration)) AS trust FROM clicks),
l AS (UNPIVOT (SELECT n, k, closure_n, hour, trust FROM r) ON k, closure_n, hour, trust INTO NAME feature VALUE r) SELECT feature, round(r * n / (n + 10.0::DOUBLE), 6) AS strength, round(r / sum(r) OVER (), 6) AS weight FROM l""")


def held_out_log_likelihood(spark, sf):
    """Log-likelihood gained by hourly zone rates over one flat rate, on the last quarter of the hours."""
    c = I.clicks(spark, sf).withColumn("hour", F.floor(F.col("t") / 3_600_000_000))
    n = c.groupBy("zone", "hour").agg(F.count(F.lit(1)).alias("n"))
    span = n.agg(F.min("hour").alias("low"), F.max("hour").alias("high"))
    grid = n.select("zone").distinct().crossJoin(F.broadcast(span)).withColumn("hour", F.explode(F.sequence("low", "high"))).join(n, ["zone", "hour"], "left").fillna(0, ["n"])
    train = F.col("hour") < F.col("low") + (F.col("high") - F.col("low")) * 0.75
    flat = grid.where(train).agg(F.avg("n").alias("flat"))
    rate = grid.where(train).groupBy("zone", (F.col("hour") % 24).alias("h")).agg(((F.sum("n") + 1) / (F.count(F.lit(1)) + 1)).alias("rate"))
    test = grid.where(~train).withColumn("h", F.col("hour") % 24).join(rate, ["zone", "h"]).crossJoin(F.broadcast(flat))
    gain = F.col("n") * F.log(F.col("rate") / F.col("flat")) - (F.col("rate") - F.col("flat"))
    return test.groupBy("zone").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("events"), r6(F.sum(gain)).alias("gain"))


register("held_out_log_likelihood", held_out_log_likelihood, f"""WITH {I.CLICKS_SQL}, n AS (SELECT zone, t // 3600000000 AS hour, count(*) AS n FROM clicks GROUP BY ALL), s AS (SELECT min(hour) AS low, max(hour) AS high FROM n),
g AS (SELECT z.zone, low, high, h.hour, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT zone FROM n) z CROSS JOIN s CROSS JOIN (SELECT unnest(range((SELECT low FROM s), (SELECT high FROM s) + 1)) AS hour) h LEFT JOIN n ON n.zone = z.zone AND n.hour = h.hour),
tr AS (SELECT * FROM g WHERE hour < low + (high - low) * 0.75::DOUBLE), f AS (SELECT avg(n) AS flat FROM tr), r AS (SELECT zone, hour % 24 AS h, (sum(n) + 1) / (count(*) + 1)::DOUBLE AS rate FROM tr GROUP BY ALL)
SELECT g.zone, count(*) AS hours, CAST(sum(g.n) AS BIGINT) AS events, round(sum(g.n * ln(rate / flat) - (rate - flat)), 6) AS gain FROM g JOIN r ON r.zone = g.zone AND r.h = g.hour % 24 CROSS JOIN f WHERE NOT g.hour < low + (high - low) * 0.75::DOUBLE GROUP BY g.zone""")


def interval_compensator(spark, sf):
    """The integral of each event's decaying effect over a window, for events before it and inside it."""
    c = I.clicks(spark, sf).withColumn("h", F.col("t") / 3.6e9)
    span = c.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    beta = 0.5
    rows = c.crossJoin(F.broadcast(span)).withColumn("s", F.col("low") + (F.col("high") - F.col("low")) * 0.5).withColumn("e", F.col("s") + 24)
    part = F.when(F.col("h") <= F.col("s"), F.exp(-beta * (F.col("s") - F.col("h"))) - F.exp(-beta * (F.col("e") - F.col("h")))).when(F.col("h") < F.col("e"), 1 - F.exp(-beta * (F.col("e") - F.col("h")))).otherwise(0.0)
    return rows.groupBy("zone").agg(F.count_if(F.col("h").between(F.col("s"), F.col("e"))).alias("inside"), r6(F.sum(F.col("trust") * part)).alias("compensator"))


register("interval_compensator", interval_compensator, f"""WITH {I.CLICKS_SQL}, c AS (SELECT *, t / 3.6e9::DOUBLE AS h FROM clicks), w AS (SELECT min(h) + (max(h) - min(h)) * 0.5::DOUBLE AS s FROM c)
SELECT zone, count(*) FILTER (h BETWEEN s AND s + 24) AS inside, round(sum(trust * CASE WHEN h <= s THEN exp(-0.5 * (s - h)) - exp(-0.5 * (s + 24 - h)) WHEN h < s + 24 THEN 1 - exp(-0.5 * (s + 24 - h)) ELSE 0 END), 6) AS compensator FROM c, w GROUP BY zone""")


def median_rows(spark, sf):
    """The element at position n // 2 of each sorted group, and long lists as delimited text and back."""
    c = I.clicks(spark, sf)
    part = W.partitionBy("zone")
    ranked = c.withColumn("r", F.row_number().over(part.orderBy("duration", "event_id"))).withColumn("n", F.count(F.lit(1)).over(part))
    top = ranked.where("r > n - 3").groupBy("zone").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string"))).alias("path"))
    middle = ranked.where("r = floor(n / 2) + 1").select("zone", "event_id", "duration")
    return middle.join(top, "zone").withColumn("steps", F.size(F.split("path", r"\|")))


register("median_rows", median_rows, f"""WITH {I.CLICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY duration, event_id) AS r, count(*) OVER (PARTITION BY zone) AS n FROM clicks), t AS (SELECT zone, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY r) AS path FROM r WHERE r > n - 3 GROUP BY zone)
SELECT r.zone, event_id, duration, path, CAST(len(string_split(path, '|')) AS INTEGER) AS steps FROM r JOIN t ON t.zone = r.zone WHERE r = n // 2 + 1""")


def robust_scenarios(spark, sf):
    sites = I.junctions(I.clicks(spark, sf)).withColumn("mu", F.log("mean_duration")).withColumn("sigma", F.lit(0.5) + F.col("closure_rate"))
    s = C.lognormal_scenarios(sites, "junction", "mu", "sigma", 200)
    kept = C.reduce_scenarios(s, "junction", 50)
    totals = s.join(F.broadcast(kept), "scenario").groupBy("scenario").agg(F.sum("duration").alias("total"), F.first("weight").alias("weight"))
    return totals.select("scenario", r6("total").alias("total"), r6("weight").alias("weight"))


register("robust_scenarios", robust_scenarios)


def cox_coefficients(spark, sf):
    rows = S.survival_table(I.shipments(spark, sf)).withColumns({"price_z": F.col("price") / 250_000 - 1, "urgent": F.col("priority").isin("1-URGENT", "2-HIGH").cast("double")})
    fit = C.cox_fit(rows, ["price_z", "urgent"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in fit.items()], "feature string, coefficient double")


register("cox_coefficients", cox_coefficients)


def survival_by_slice(spark, sf):
    """Weighted at-risk and event counts by month of start, with the share still open."""
    rows = S.survival_table(I.shipments(spark, sf)).withColumn("month", F.date_format("start_ts", "yyyy-MM"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), r6(F.sum("weight")).alias("weight"), r6(F.avg((F.col("event") == 0).cast("double"))).alias("open_share"))


register("survival_by_slice", survival_by_slice, f"WITH {SURV_SQL} SELECT strftime(start_ts, '%Y-%m') AS month, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, round(sum(weight), 6) AS weight, round(avg(CASE WHEN event = 0 THEN 1.0 ELSE 0.0 END), 6) AS open_share FROM surv GROUP BY 1")
