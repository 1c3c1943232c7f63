"""Queries: adapters, scalar expressions, quality and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import incidents as I
from siltstone.operators import quality as Q
from siltstone.operators import relational as R
from siltstone.operators import survival as S
from siltstone.plans.catalogue import register
from siltstone.sources import tables as T


def r6(c):
    return F.round(c, 6)


# --- flagship: duration quantiles with hierarchical fallback
def duration_quantiles_fallback(spark, sf):
    rows = I.shipments(spark, sf).where(~F.col("is_censored") & (F.col("duration") > 0))
    q = F.percentile("duration", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)))

    def level(keys):
        t = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
        return t.select(*keys, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("p50", "p80", "p95"))])

    wanted = I.shipments(spark, sf).select("event_cause", "corridor").distinct()
    levels = [("stratum", level(["event_cause", "corridor"]), ["event_cause", "corridor"]), ("cause", level(["event_cause"]), ["event_cause"]), ("global", level([]), [])]
    out = R.fallback_lookup(levels, wanted, ["p50", "p80", "p95"], {"p50": 60.0, "p80": 120.0, "p95": 180.0})
    return out.select("event_cause", "corridor", "level", "support", *[r6(c).alias(c) for c in ("p50", "p80", "p95")])


register("duration_quantiles_fallback", duration_quantiles_fallback, f"""
WITH {I.SHIPMENTS_SQL},
rows AS (SELECT * FROM shipments WHERE NOT is_censored AND duration > 0),
s AS (SELECT event_cause, corridor, count(*) AS n, quantile_cont(duration, [0.5, 0.8, 0.95]) AS q FROM rows GROUP BY ALL),
c AS (SELECT event_cause, count(*) AS n, quantile_cont(duration, [0.5, 0.8, 0.95]) AS q FROM rows GROUP BY ALL),
g AS (SELECT count(*) AS n, quantile_cont(duration, [0.5, 0.8, 0.95]) AS q FROM rows),
p AS (
  SELECT w.event_cause, w.corridor, CASE WHEN s.n >= 5 THEN 'stratum' WHEN c.n >= 5 THEN 'cause' WHEN g.n >= 5 THEN 'global' ELSE 'constant' END AS level,
         CASE WHEN s.n >= 5 THEN s.n WHEN c.n >= 5 THEN c.n WHEN g.n >= 5 THEN g.n ELSE 0 END AS support,
         CASE WHEN s.n >= 5 THEN s.q WHEN c.n >= 5 THEN c.q WHEN g.n >= 5 THEN g.q ELSE [60.0, 120.0, 180.0] END AS q
  FROM (SELECT DISTINCT event_cause, corridor FROM shipments) w LEFT JOIN s USING (event_cause, corridor) LEFT JOIN c USING (event_cause) CROSS JOIN g)
SELECT event_cause, corridor, level, CAST(support AS BIGINT) AS support, round(q[1], 6) AS p50, round(q[2], 6) AS p80, round(q[3], 6) AS p95 FROM p""")


# --- scalar cleaning: local time, labels, flags, places
def scalar_cleaning(spark, sf):
    c = I.clicks(spark, sf)
    parts = X.local_parts(F.col("ts"), "Asia/Kolkata")
    c = c.withColumns(parts).withColumns(X.cyclical(F.col("hour_local"), F.col("dow_local")))
    label = X.canonical_cause(F.concat(F.lit("  "), F.upper("event_cause"), F.when(F.col("k") % 7 == 0, " / X").otherwise("")), {"view": "page_view"})
    flag = X.parse_flag(F.element_at(F.array(*[F.lit(v) for v in ("true", "F", "1", "no", "maybe")]), (F.col("k") % 5 + 1)))
    corridor = X.clean_corridor(F.when(F.col("corridor") == 3, None).otherwise(F.concat(F.lit(" c "), F.col("corridor").cast("string"))))
    return c.groupBy("dow_local", "is_weekend", "is_peak", label.alias("cause"), flag.alias("flag"), corridor.alias("corridor")).agg(
        F.count(F.lit(1)).alias("n"), (r6(F.sum("hour_sin")) + 0.0).alias("hour_sin"), (r6(F.sum("dow_cos")) + 0.0).alias("dow_cos"), F.count_distinct("date_local").alias("days"), F.count_if(X.geo_valid(F.col("k") - 10.0, F.col("k") - 50.0)).alias("n_geo")
    )


register("scalar_cleaning", scalar_cleaning, f"""
WITH {I.CLICKS_SQL},
l AS (SELECT *, ts + INTERVAL 330 MINUTE AS local FROM clicks),
p AS (SELECT *, hour(local) AS h, CAST(isodow(local) - 1 AS INTEGER) AS dow_local FROM l),
x AS (
  SELECT *, CAST(dow_local IN (5, 6) AS INTEGER) AS is_weekend, CAST(h BETWEEN 7 AND 10 OR h BETWEEN 17 AND 20 AS INTEGER) AS is_peak,
    CASE WHEN k % 7 = 0 THEN event_cause || '_x' WHEN event_cause = 'view' THEN 'page_view' ELSE event_cause END AS cause,
    CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag,
    CASE WHEN corridor = 3 THEN 'Non-corridor' ELSE 'c ' || corridor END AS corr
  FROM p)
SELECT dow_local, is_weekend, is_peak, cause, flag, corr AS corridor, count(*) AS n, round(sum(sin(h * 2 * pi() / 24)), 6) + 0.0 AS hour_sin, round(sum(cos(dow_local * 2 * pi() / 7)), 6) + 0.0 AS dow_cos,
  count(DISTINCT CAST(local AS DATE)) AS days, count(*) FILTER (abs(k - 10) > 1 AND abs(k - 50) > 1) AS n_geo
FROM x GROUP BY ALL""")


# --- scalar maths: distance, buckets, labels, blends
def scalar_maths(spark, sf):
    c = I.clicks(spark, sf)
    p50, p80, p95 = F.col("duration"), F.col("duration") * (F.col("k") + 10) / 50, F.col("duration") * (F.col("k") + 1) / 8
    t = X.sorted_quantiles(p50, p80, p95)
    rel = X.clip(0.25 * F.col("trust") + 0.75 * X.clip(F.col("k") / 100.0, 0.1, 0.9), 0.0, 1.0)
    mu, sigma = X.lognormal_from_quantiles(F.greatest(F.col("s50"), F.lit(0.01)), F.greatest(F.col("s95"), F.lit(0.02)))
    rows = c.withColumns(t).withColumn("reliability", rel).withColumn("mu", mu).withColumn("sigma", sigma)
    rows = rows.withColumn("sane", X.sane_quantiles(F.col("s50"), F.col("s80"), F.col("s95"))).withColumn("why", X.reasons({"crossed": F.col("crossed"), "clamped": F.col("clamped"), "low": F.col("reliability") < 0.3}))
    rows = rows.withColumn("inflated", F.col("sigma") * (1 + F.when(F.col("sane"), 0.5).otherwise(0.75) * (1 - F.col("reliability"))))
    blended = F.when(F.col("reliability") < 0.3, 0.7 * F.col("s50") + 0.3 * 60).otherwise(F.col("s50"))
    tier = X.cases([(F.col("reliability") >= 0.7, "high"), (F.col("reliability") >= 0.4, "medium")], "low")
    km = X.haversine_km(F.lit(12.9), F.lit(77.5), 12 + F.col("k") / 100.0, 77 + F.col("zone") / 10.0)
    eff = X.effectiveness([(F.col("k") / 10.0, 0.18), (F.col("zone").cast("double"), 0.10)])
    return rows.groupBy(tier.alias("tier"), F.col("why"), F.col("sane"), X.duration_label(F.floor(F.col("duration") / 40) * 600).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("s80")).alias("p80"), r6(F.avg("inflated")).alias("sigma"), r6(F.avg(blended)).alias("blended"), r6(F.max(km)).alias("km"), r6(F.avg(eff)).alias("effect"), r6(F.avg(F.log1p("duration"))).alias("log_duration")
    )


register("scalar_maths", scalar_maths, f"""
WITH {I.CLICKS_SQL},
q AS (SELECT *, duration AS p50, duration * (k + 10) / 50 AS p80, duration * (k + 1) / 8 AS p95 FROM clicks),
o AS (SELECT *, list_sort([p50, p80, p95]) AS s FROM q),
c AS (SELECT *, list_sort([s[1], s[2], least(s[3], greatest(s[1] * 10, 1440.0))]) AS tq, (p50 > p80 OR p80 > p95) AS crossed, s[3] > least(s[3], greatest(s[1] * 10, 1440.0)) AS clamped FROM o),
m AS (
  SELECT *, greatest(0.0, least(1.0, 0.25 * trust + 0.75 * greatest(0.1, least(0.9, k / 100.0::DOUBLE)))) AS reliability,
    greatest((ln(greatest(tq[3], 0.02)) - ln(greatest(tq[1], 0.01))) / 1.645::DOUBLE, 0.1) AS sigma,
    NOT (tq[1] > 10080 OR tq[3] > 10080 OR tq[3] > greatest(240.0, tq[1] * 15) OR (tq[2] = tq[3] AND tq[3] > 1440)) AS sane
  FROM c),
w AS (SELECT *, nullif(concat_ws('|', CASE WHEN crossed THEN 'crossed' END, CASE WHEN clamped THEN 'clamped' END, CASE WHEN reliability < 0.3 THEN 'low' END), '') AS why, floor(duration / 40) * 600 AS label_minutes FROM m)
SELECT CASE WHEN reliability >= 0.7 THEN 'high' WHEN reliability >= 0.4 THEN 'medium' ELSE 'low' END AS tier, why, sane,
  CASE WHEN label_minutes < 60 THEN CAST(CAST(floor(label_minutes) AS BIGINT) AS VARCHAR) || ' min' WHEN label_minutes < 1440 THEN CAST(CAST(floor(label_minutes / 60) AS BIGINT) AS VARCHAR) || ' h' ELSE CAST(CAST(floor(label_minutes / 1440) AS BIGINT) AS VARCHAR) || ' d' END AS label,
  count(*) AS n, round(avg(tq[2]), 6) AS p80, round(avg(sigma * (1 + CASE WHEN sane THEN 0.5 ELSE 0.75 END * (1 - reliability))), 6) AS sigma,
  round(avg(CASE WHEN reliability < 0.3 THEN 0.7 * tq[1] + 0.3 * 60 ELSE tq[1] END), 6) AS blended,
  round(max(2 * 6371 * asin(sqrt(least(1.0, sin(radians(12 + k / 100.0::DOUBLE - 12.9) / 2) ** 2 + cos(radians(12.9)) * cos(radians(12 + k / 100.0::DOUBLE)) * sin(radians(77 + zone / 10.0::DOUBLE - 77.5) / 2) ** 2)))), 6) AS km,
  round(avg(least(0.9, 1 - exp(-(k / 10.0::DOUBLE * 0.18 + zone * 0.10::DOUBLE)))), 6) AS effect, round(avg(ln(1 + duration)), 6) AS log_duration
FROM w GROUP BY ALL""")


# --- trust, codes, collapse
def trust_score_profile(spark, sf):
    return I.shipments(spark, sf).groupBy("event_cause").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("trust")).alias("mean_trust"), r6(F.avg((F.col("trust") < 0.5).cast("double"))).alias("low_share"), F.count_if(F.coalesce(F.col("duration") < 0, F.lit(False))).alias("n_negative"), F.count_if(F.col("end_ts").isNull()).alias("n_open")
    )


register("trust_score_profile", trust_score_profile, f"""
WITH {I.SHIPMENTS_SQL}
SELECT event_cause, count(*) AS n, round(avg(trust), 6) AS mean_trust, round(avg(CASE WHEN trust < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_share,
  count(*) FILTER (duration < 0) AS n_negative, count(*) FILTER (end_ts IS NULL) AS n_open FROM shipments GROUP BY event_cause""")


def categorical_codes(spark, sf):
    codes = R.category_codes(I.shipments(spark, sf), "priority")
    return I.shipments(spark, sf).join(F.broadcast(codes), "priority").groupBy("priority", F.col("priority_code")).agg(F.count(F.lit(1)).alias("n"))


register("categorical_codes", categorical_codes, "SELECT o_orderpriority AS priority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS priority_code, count(*) AS n FROM orders GROUP BY o_orderpriority")


def top_n_other(spark, sf):
    return R.top_n_or_other(I.shipments(spark, sf), "corridor", 8).groupBy("corridor").agg(F.count(F.lit(1)).alias("n"))


register("top_n_other", top_n_other, f"""
WITH {I.SHIPMENTS_SQL}, top AS (SELECT corridor FROM shipments WHERE corridor IS NOT NULL GROUP BY corridor ORDER BY count(*) DESC, corridor LIMIT 8)
SELECT coalesce(t.corridor, 'Other') AS corridor, count(*) AS n FROM shipments s LEFT JOIN top t ON s.corridor = t.corridor GROUP BY 1""")

RULES = ("negative_duration", "no_end", "no_place", "too_long")


def _quarantined(spark, sf):
    rows = I.shipments(spark, sf)
    rules = dict(zip(RULES, (F.coalesce(F.col("duration") < 0, F.lit(False)), F.col("end_ts").isNull(), F.col("junction").isNull(), F.coalesce(F.col("duration") > 3000, F.lit(False))), strict=True))
    return Q.quarantine(rows, rules, "duration")


def quarantine_reason_summary(spark, sf):
    return Q.quarantine_summary(_quarantined(spark, sf), [*RULES, "never"])


register("quarantine_reason_summary", quarantine_reason_summary, f"""
WITH {I.SHIPMENTS_SQL}
SELECT unnest(['negative_duration', 'no_end', 'no_place', 'too_long', 'never']) AS reason,
  unnest([count(*) FILTER (duration < 0), count(*) FILTER (end_ts IS NULL), count(*) FILTER (junction IS NULL), count(*) FILTER (duration > 3000), 0]) AS rows FROM shipments""")


def quarantine_clean_copy(spark, sf):
    return _quarantined(spark, sf).groupBy("quarantine_reasons").agg(F.count(F.lit(1)).alias("n"), F.count("duration").alias("n_duration"), r6(F.avg("duration")).alias("mean_duration"))


register("quarantine_clean_copy", quarantine_clean_copy, f"""
WITH {I.SHIPMENTS_SQL}, q AS (SELECT *, nullif(concat_ws('|', CASE WHEN duration < 0 THEN 'negative_duration' END, CASE WHEN end_ts IS NULL THEN 'no_end' END, CASE WHEN junction IS NULL THEN 'no_place' END, CASE WHEN duration > 3000 THEN 'too_long' END), '') AS quarantine_reasons FROM shipments)
SELECT quarantine_reasons, count(*) AS n, count(CASE WHEN quarantine_reasons IS NULL THEN duration END) AS n_duration, round(avg(CASE WHEN quarantine_reasons IS NULL THEN duration END), 6) AS mean_duration FROM q GROUP BY 1""")


def mad_outliers(spark, sf):
    z = Q.modified_z(I.shipments(spark, sf), "duration", [["event_cause", "corridor"], ["event_cause"], []])
    return z.groupBy("event_cause", "z_level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("modified_z") > 3.5).alias("n_anomalies"), r6(F.max("modified_z")).alias("max_z"), r6(F.min("modified_z")).alias("min_z"))


register("mad_outliers", mad_outliers, f"""
WITH {I.SHIPMENTS_SQL}, v AS (SELECT * FROM shipments WHERE duration >= 0),
m0 AS (SELECT event_cause, corridor, median(duration) AS m, count(*) AS n FROM v GROUP BY ALL), m1 AS (SELECT event_cause, median(duration) AS m, count(*) AS n FROM v GROUP BY ALL), m2 AS (SELECT median(duration) AS m, count(*) AS n FROM v),
d0 AS (SELECT v.event_cause, v.corridor, any_value(m) AS m, any_value(n) AS n, median(abs(duration - m)) AS d FROM v JOIN m0 ON v.event_cause IS NOT DISTINCT FROM m0.event_cause AND v.corridor IS NOT DISTINCT FROM m0.corridor GROUP BY v.event_cause, v.corridor),
d1 AS (SELECT v.event_cause, any_value(m) AS m, any_value(n) AS n, median(abs(duration - m)) AS d FROM v JOIN m1 ON v.event_cause IS NOT DISTINCT FROM m1.event_cause GROUP BY v.event_cause),
d2 AS (SELECT any_value(m) AS m, any_value(n) AS n, median(abs(duration - m)) AS d FROM v, m2),
z AS (
  SELECT s.event_cause, CASE WHEN s.duration >= 0 THEN CASE WHEN d0.n >= 10 AND d0.d > 0 THEN 0 WHEN d1.n >= 10 AND d1.d > 0 THEN 1 WHEN d2.d > 0 THEN 2 END END AS z_level,
    CASE WHEN s.duration >= 0 THEN CASE WHEN d0.n >= 10 AND d0.d > 0 THEN 0.6745 * (s.duration - d0.m) / d0.d WHEN d1.n >= 10 AND d1.d > 0 THEN 0.6745 * (s.duration - d1.m) / d1.d WHEN d2.d > 0 THEN 0.6745 * (s.duration - d2.m) / d2.d END END AS z
  FROM shipments s LEFT JOIN d0 ON s.event_cause IS NOT DISTINCT FROM d0.event_cause AND s.corridor IS NOT DISTINCT FROM d0.corridor LEFT JOIN d1 ON s.event_cause IS NOT DISTINCT FROM d1.event_cause CROSS JOIN d2)
SELECT event_cause, z_level, count(*) AS n, count(*) FILTER (abs(z) > 3.5) AS n_anomalies, round(max(z), 6) AS max_z, round(min(z), 6) AS min_z FROM z GROUP BY ALL""")


def robust_scaling(spark, sf):
    rows = I.early(I.clicks(spark, sf), 0.7).withColumn("k", F.col("k").cast("double"))
    z = Q.robust_scale(rows, ["duration", "k"], F.col("early"))
    return z.groupBy("event_cause").agg(r6(F.avg("duration_scaled")).alias("duration_scaled"), r6(F.max("k_scaled")).alias("k_scaled"))


register("robust_scaling", robust_scaling, f"""
WITH {I.CLICKS_SQL}, t AS (SELECT * FROM clicks WHERE {I.early_sql(0.7)}), m AS (SELECT median(duration) AS a, median(k) AS b FROM t),
d AS (SELECT median(abs(duration - a)) AS da, median(abs(k - b)) AS db, any_value(a) AS a, any_value(b) AS b FROM t, m)
SELECT event_cause, round(avg((duration - a) / (da * 1.4826)), 6) AS duration_scaled, round(max((k - b) / (db * 1.4826)), 6) AS k_scaled FROM clicks, d GROUP BY event_cause""")


# --- survival
def _survival(spark, sf):
    return S.survival_table(I.shipments(spark, sf))


SURV_SQL = f"""{I.SHIPMENTS_SQL},
study AS (SELECT max(greatest(start_ts, coalesce(end_ts, start_ts))) AS study_end FROM shipments),
surv0 AS (SELECT *, CASE WHEN is_censored THEN CAST(date_diff('day', start_ts, study_end) AS DOUBLE) ELSE duration END AS T, CASE WHEN is_censored THEN 0 ELSE 1 END AS event, greatest(0.01, least(1.0, trust)) AS weight FROM shipments, study),
surv AS (SELECT * FROM surv0 WHERE T >= 0)"""


def km_sql(keys: str) -> str:
    return f"""
times AS (SELECT {keys}, T, sum(CASE WHEN event = 1 THEN weight ELSE 0 END) AS d, sum(weight) AS w, count(*) AS n, sum(event) AS events FROM surv GROUP BY {keys}, T),
risk AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY T ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM times),
km AS (SELECT *, CASE WHEN max(CASE WHEN 1 - d / at_risk <= 1e-12 THEN 1 ELSE 0 END) OVER p = 1 THEN 0.0 ELSE exp(sum(ln(greatest(1 - d / at_risk, 1e-300))) OVER p) END AS S FROM risk WINDOW p AS (PARTITION BY {keys} ORDER BY T ROWS UNBOUNDED PRECEDING))"""


def survival_profile(spark, sf):
    return _survival(spark, sf).groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("n_events"), r6(F.sum("weight")).alias("weight"), F.max("T").alias("max_t"), r6(F.avg((F.col("T") > 180).cast("double"))).alias("share_over_180"), r6(F.avg(F.least(F.col("T"), F.lit(180.0)))).alias("capped_mean"))


register("survival_profile", survival_profile, f"""WITH {SURV_SQL}
SELECT event_cause, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, round(sum(weight), 6) AS weight, max(T) AS max_t, round(avg(CASE WHEN T > 180 THEN 1.0 ELSE 0.0 END), 6) AS share_over_180, round(avg(least(T, 180.0)), 6) AS capped_mean FROM surv GROUP BY event_cause""")


def km_quantiles_by_stratum(spark, sf):
    keys = ["event_cause", "corridor"]
    q = S.km_quantiles(S.kaplan_meier(_survival(spark, sf), keys), keys)
    return q.select(*keys, "n", "n_events", r6("weighted_n").alias("weighted_n"), "p50", "p80", "p95")


register("km_quantiles_by_stratum", km_quantiles_by_stratum, f"""WITH {SURV_SQL}, {km_sql("event_cause, corridor")}
SELECT event_cause, corridor, CAST(sum(n) AS BIGINT) AS n, CAST(sum(events) AS BIGINT) AS n_events, round(sum(w), 6) AS weighted_n, coalesce(min(T) FILTER (S <= 0.5 + 1e-9), max(T)) AS p50,
  coalesce(min(T) FILTER (S <= 0.2 + 1e-9), max(T)) AS p80, coalesce(min(T) FILTER (S <= 0.05 + 1e-9), max(T)) AS p95 FROM km GROUP BY event_cause, corridor HAVING sum(n) >= 15""")


def rmst_by_stratum(spark, sf):
    rows = _survival(spark, sf).where(F.col("event_cause").isNotNull())
    out = S.restricted_mean(S.kaplan_meier(rows, ["event_cause"]), ["event_cause"], (60, 180, 360, 720))
    return out.select("event_cause", *[r6(c).alias(c) for c in out.columns[1:]])


register("rmst_by_stratum", rmst_by_stratum, f"""WITH {SURV_SQL}, {km_sql("event_cause")},
st AS (SELECT *, coalesce(lag(T) OVER o, 0) AS t0, coalesce(lag(S) OVER o, 1) AS s0, lead(T) OVER o IS NULL AS last FROM km WHERE event_cause IS NOT NULL WINDOW o AS (PARTITION BY event_cause ORDER BY T)),
h AS (SELECT event_cause, tau, sum(CASE WHEN least(T, tau) - t0 > 0 THEN (least(T, tau) - t0) * (s0 + CASE WHEN T <= tau THEN S ELSE s0 END) / 2 ELSE 0 END + CASE WHEN last AND T < tau THEN (tau - T) * S ELSE 0 END) AS a FROM st, (SELECT unnest([60.0::DOUBLE, 180.0::DOUBLE, 360.0::DOUBLE, 720.0::DOUBLE]) AS tau) GROUP BY event_cause, tau)
SELECT event_cause, round(max(a) FILTER (tau = 60), 6) AS rmst_60, round(max(a) FILTER (tau = 180), 6) AS rmst_180, round(max(a) FILTER (tau = 360), 6) AS rmst_360, round(max(a) FILTER (tau = 720), 6) AS rmst_720 FROM h GROUP BY event_cause""")


def survival_reliability_deciles(spark, sf):
    out = S.reliability_deciles(_survival(spark, sf), "price", 180)
    return out.select("bin", "n", r6("mean_predicted").alias("mean_predicted"), r6("observed").alias("observed"))


register("survival_reliability_deciles", survival_reliability_deciles, f"""WITH {SURV_SQL},
known AS (SELECT * FROM surv WHERE event = 1 OR T > 180), p AS (SELECT *, (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p FROM known),
e AS (SELECT list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM p),
b AS (SELECT *, greatest(1, len(list_filter(edges, lambda x: x < p))) AS bin FROM p, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(CASE WHEN event = 1 AND T <= 180 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM b GROUP BY bin""")


# --- served pages and projected scans
SERVED = T.Dataset("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_acctbal", True, 20)


def table_query_page(spark, sf):
    return T.page(T.table(spark, sf, SERVED.table), SERVED, text="1", page=2)


register("table_query_page", table_query_page, """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE contains(lower(concat_ws(' ', s_suppkey, s_name, s_nationkey, s_acctbal)), '1')
ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20""")


def projected_scan(spark, sf):
    view = T.export_view(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_shipdate", "l_quantity", "missing"])
    return view.where((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_quantity") < 5)).groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


register("projected_scan", projected_scan, "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_quantity < 5 GROUP BY 1")


def rank_percent_orders(spark, sf):
    rows = I.shipments(spark, sf).withColumn("pct", R.rank_percent(F.col("duration"), ["event_cause"])).where(F.col("duration").isNotNull())
    return rows.groupBy("event_cause").agg(r6(F.avg("pct")).alias("mean_pct"), r6(F.max(F.when(F.col("duration") < 0, F.col("pct")))).alias("negative_share"))


register("rank_percent", rank_percent_orders, f"""
WITH {I.SHIPMENTS_SQL}, p AS (SELECT event_cause, duration, (rank() OVER (PARTITION BY event_cause ORDER BY duration NULLS FIRST) + (count(*) OVER (PARTITION BY event_cause, duration) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY event_cause) AS pct FROM shipments)
SELECT event_cause, round(avg(pct), 6) AS mean_pct, round(max(pct) FILTER (duration < 0), 6) AS negative_share FROM p WHERE duration IS NOT NULL GROUP BY event_cause""")


def concordance_index(spark, sf):
    return S.concordance(_survival(spark, sf), "price").select("usable", r6("c_index").alias("c_index"))


register("concordance_index", concordance_index, f"""WITH {SURV_SQL}, pairs AS (SELECT count(*) AS usable, sum(CASE WHEN a.price > b.price THEN 1.0::DOUBLE WHEN a.price = b.price THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS won
  FROM surv a JOIN surv b ON a.event = 1 AND a.T < b.T WHERE a.price IS NOT NULL AND b.price IS NOT NULL)
SELECT CAST(usable AS BIGINT) AS usable, round(won / usable, 6) AS c_index FROM pairs""")
