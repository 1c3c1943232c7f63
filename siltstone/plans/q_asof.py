"""Query: the point-in-time feature matrix, and SQL that states it from the events themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import asof
from siltstone.operators import incidents as I
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6


def asof_features(spark, sf):
    """All columns for every event; planned events are those with k of 70 or more, rates are fitted on the first 75 % of the time."""
    c = I.early(I.clicks(spark, sf), 0.75).withColumns({"priority": F.col("k") % 4, "planned": F.coalesce(F.col("k") >= 70, F.lit(False))})
    out = asof.feature_matrix(c, c.where("early"))
    return out.select(*[r6(n).alias(n) if t == "double" else n for n, t in out.dtypes])


_LEVELS = (("cc", "cause_corridor", "h.event_cause = a.event_cause AND h.corridor = a.corridor"), ("co", "cause_only", "h.event_cause = a.event_cause"), ("ro", "corridor_only", "h.corridor = a.corridor"), ("gl", "global", "true"))
_STATE = ", ".join(
    f"{n} AS (SELECT a.day, a.event_cause, a.corridor, count(*) AS support, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.8) AS p80, quantile_cont(v, 0.95) AS p95, avg((v > 60)::INT) AS s60, avg((v > 120)::INT) AS s120, avg((v > 180)::INT) AS s180, avg(least(v, 180)) AS rmst FROM asked a JOIN resolved h ON {on} AND h.day <= a.day - 2 GROUP BY ALL)"
    for n, _, on in _LEVELS
)


def _chosen(column: str, otherwise: str) -> str:
    return f"CASE WHEN cc.support >= 5 THEN cc.{column} WHEN co.support >= 5 THEN co.{column} WHEN ro.support >= 5 THEN ro.{column} WHEN gl.support >= 5 THEN gl.{column} ELSE {otherwise} END AS {column}"


_ROUNDED = "asof_p50_duration asof_p80_duration asof_p95_duration asof_surv_prob_60 asof_surv_prob_120 asof_surv_prob_180 asof_rmst_180 asof_corridor_burden asof_junction_burden asof_obi_proxy asof_corridor_event_rate asof_nbr_mean_burden asof_nbr_mean_duration asof_fragility_proxy asof_hawkes_intensity asof_burstiness asof_branching_ratio_proxy asof_retrieval_confidence asof_retrieval_n_eff asof_retrieval_mean_sim asof_retrieval_max_sim asof_ims_proxy obi_x_fragility retrieval_x_risk fragility_x_duration trust_x_confidence hotspot_x_duration hawkes_x_obi nbr_mean_obi nbr_mean_fragility nbr_mean_duration nbr_mean_severity".split()

register("asof_features", asof_features, f"""WITH {I.CLICKS_SQL},
e AS (SELECT *, t // 86400000000 AS day, (t // 3600000000) % 24 AS hour, (t // 86400000000 + 3) % 7 AS dow, closure::INT AS shut, k % 4 AS priority, floor(duration * 10 + 0.5) / 10 AS v, {I.early_sql(0.75)} AS early FROM clicks),
resolved AS (SELECT * FROM e WHERE NOT is_censored AND duration > 0), asked AS (SELECT DISTINCT day, event_cause, corridor FROM e), {_STATE},
d AS (SELECT a.*, {_chosen('support', 'coalesce(gl.support, 0)')}, {_chosen('p50', 'coalesce(gl.p50, 60)')}, {_chosen('p80', 'coalesce(gl.p80, 120)')}, {_chosen('p95', 'coalesce(gl.p95, 180)')},
  {_chosen('s60', 'coalesce(cc.s60, 0.5)')}, {_chosen('s120', 'coalesce(cc.s120, 0.5)')}, {_chosen('s180', 'coalesce(cc.s180, 0.5)')}, {_chosen('rmst', 'coalesce(cc.rmst, 90)')},
  CASE WHEN cc.support >= 5 THEN 'cause_corridor' WHEN co.support >= 5 THEN 'cause_only' WHEN ro.support >= 5 THEN 'corridor_only' ELSE 'global' END AS level
  FROM asked a {' '.join(f'LEFT JOIN {n} ON {n}.day = a.day AND {n}.event_cause = a.event_cause AND {n}.corridor = a.corridor' for n, _, _ in _LEVELS)}),
g AS (SELECT corridor, unnest(range((SELECT min(day) FROM e), (SELECT max(day) FROM e) + 1)) AS day FROM (SELECT DISTINCT corridor FROM e)),
c0 AS (SELECT g.corridor, g.day, count(h.t) AS rate, coalesce(sum(exp(-0.05 * (g.day - 1 - h.t / 86400000000.0::DOUBLE))), 0) AS burden, coalesce(sum(exp(-0.1 * ((g.day - 1) * 86400000000 - h.t) / 3600000000.0::DOUBLE)), 0) AS kernel, max(h.t) AS last
  FROM g LEFT JOIN e h ON h.corridor = g.corridor AND h.day <= g.day - 2 GROUP BY ALL),
gaps AS (SELECT c0.corridor, c0.day, (h.t - lag(h.t) OVER (PARTITION BY c0.corridor, c0.day ORDER BY h.t)) / 60e6 AS gap FROM c0 JOIN e h ON h.corridor = c0.corridor AND h.t <= c0.last AND h.t >= c0.last - 86400000000),
b AS (SELECT corridor, day, coalesce(stddev_samp(gap) / (avg(gap) + 1e-6), 0) AS burst FROM gaps GROUP BY ALL),
m AS (SELECT DISTINCT zone, corridor FROM e), md AS (SELECT g.corridor, g.day, median(h.v) AS median FROM g JOIN resolved h ON h.corridor = g.corridor AND h.day <= g.day - 2 GROUP BY ALL),
near AS (SELECT x.corridor, c0.day, avg(c0.burden) AS near_burden, avg(md.median) AS near_duration FROM m x JOIN m y ON x.zone = y.zone AND x.corridor <> y.corridor JOIN c0 ON c0.corridor = y.corridor LEFT JOIN md ON md.corridor = y.corridor AND md.day = c0.day GROUP BY ALL),
jb AS (SELECT a.junction, a.day, sum(exp(-0.05 * (a.day - 1 - h.t / 86400000000.0::DOUBLE))) AS junction_burden FROM (SELECT DISTINCT junction, day FROM e) a JOIN e h ON h.junction = a.junction AND h.day <= a.day - 2 GROUP BY ALL),
tr AS (SELECT count(*) AS n, greatest((max(t) - min(t)) / 86400000000.0::DOUBLE, 1) AS days, count(DISTINCT corridor) AS corridors, quantile_cont(v, 0.75) AS tau FROM resolved WHERE early),
tc AS (SELECT corridor, count(*) / any_value(days) AS mu FROM (SELECT corridor FROM resolved WHERE early), (SELECT days FROM tr) GROUP BY corridor),
ta AS (SELECT event_cause, quantile_cont(v, 0.75) AS tau FROM resolved WHERE early GROUP BY event_cause HAVING count(*) >= 5),
rg AS (SELECT a.day, greatest(max(hour) - min(hour), 0) AS rh, greatest(max(dow) - min(dow), 0) AS rd, max(shut) - min(shut) AS rs FROM (SELECT DISTINCT day FROM e) a JOIN e h ON h.day <= a.day - 2 GROUP BY a.day),
pl AS (SELECT hour, dow, shut, event_cause, corridor, zone, priority, day, count(*) AS n FROM e WHERE k >= 70 GROUP BY ALL), q AS (SELECT DISTINCT day, hour, dow, shut, event_cause, corridor, zone, priority FROM e),
sim AS (SELECT q.*, p.n, (1 - least(abs(q.hour - p.hour) / CASE WHEN rh > 0 THEN rh ELSE 1 END::DOUBLE, 1) + 1 - least(abs(q.dow - p.dow) / CASE WHEN rd > 0 THEN rd ELSE 1 END::DOUBLE, 1) + 1 - least(abs(q.shut - p.shut) / CASE WHEN rs > 0 THEN rs ELSE 1 END::DOUBLE, 1)
  + (q.event_cause = p.event_cause)::INT + (q.corridor = p.corridor)::INT + (q.zone = p.zone)::INT + (q.priority = p.priority)::INT) / 7 AS s FROM q JOIN rg ON rg.day = q.day JOIN pl p ON p.day <= q.day - 2),
rt AS (SELECT day, hour, dow, shut, event_cause, corridor, zone, priority, sum(n)::BIGINT AS cases, sum(n * s) / sum(n) AS mean_sim, max(s) AS max_sim FROM sim GROUP BY ALL),
f AS (SELECT e.event_id, e.trust, strftime(make_date(greatest(e.day - 1, (SELECT min(day) FROM e))::INT), '%Y-%m-%d') AS snapshot_date, p50 AS asof_p50_duration, p80 AS asof_p80_duration, p95 AS asof_p95_duration, s60 AS asof_surv_prob_60, s120 AS asof_surv_prob_120, s180 AS asof_surv_prob_180, rmst AS asof_rmst_180,
  level AS asof_quantile_fallback_level, support AS asof_quantile_support, burden AS asof_corridor_burden, coalesce(junction_burden, 0) AS asof_junction_burden, burden / (1 + coalesce(junction_burden, 0)) AS asof_obi_proxy, rate::DOUBLE AS asof_corridor_event_rate,
  coalesce(near_burden, 0) AS asof_nbr_mean_burden, coalesce(near_duration, p50) AS asof_nbr_mean_duration, coalesce(tc.mu, tr.n / (tr.days * tr.corridors)) AS mu,
  mu + CASE WHEN tc.mu IS NULL THEN least(0.2, 0.5 * tr.n / (tr.days * tr.corridors)) ELSE least(0.3, 0.4 * tc.mu) END * kernel AS asof_hawkes_intensity, coalesce(burst, 0) AS asof_burstiness, CASE WHEN p80 > coalesce(ta.tau, tr.tau) THEN 1 ELSE 0 END AS high,
  coalesce(cases, 0)::DOUBLE AS asof_retrieval_n_eff, coalesce(mean_sim, 0) AS asof_retrieval_mean_sim, coalesce(max_sim, 0) AS asof_retrieval_max_sim, coalesce(cases, 0) AS asof_planned_support,
  0.0::DOUBLE + asof_retrieval_n_eff / (asof_retrieval_n_eff + 2) * asof_retrieval_mean_sim * asof_retrieval_max_sim AS asof_retrieval_confidence, asof_retrieval_mean_sim * ln(1 + asof_retrieval_n_eff) AS asof_ims_proxy,
  CASE WHEN asof_planned_support >= 3 THEN 'exact' ELSE 'low_support' END AS asof_retrieval_fallback, mu + 0.5 * asof_hawkes_intensity AS asof_fragility_proxy, least(asof_hawkes_intensity / (mu + 1e-6), 3) AS asof_branching_ratio_proxy
  FROM e JOIN d USING (day, event_cause, corridor) JOIN c0 ON c0.corridor = e.corridor AND c0.day = e.day LEFT JOIN b ON b.corridor = e.corridor AND b.day = e.day LEFT JOIN near ON near.corridor = e.corridor AND near.day = e.day LEFT JOIN jb ON jb.junction = e.junction AND jb.day = e.day
  LEFT JOIN tc ON tc.corridor = e.corridor LEFT JOIN ta ON ta.event_cause = e.event_cause LEFT JOIN rt ON rt.day = e.day AND rt.hour = e.hour AND rt.dow = e.dow AND rt.shut = e.shut AND rt.event_cause = e.event_cause AND rt.corridor = e.corridor AND rt.zone = e.zone AND rt.priority = e.priority, tr),
x AS (SELECT *, asof_obi_proxy * asof_fragility_proxy AS obi_x_fragility, asof_retrieval_confidence * high AS retrieval_x_risk, asof_fragility_proxy * asof_p50_duration AS fragility_x_duration, trust * asof_retrieval_confidence AS trust_x_confidence, asof_corridor_burden * asof_p50_duration AS hotspot_x_duration,
  asof_hawkes_intensity * asof_obi_proxy AS hawkes_x_obi, asof_nbr_mean_burden AS nbr_mean_obi, asof_fragility_proxy AS nbr_mean_fragility, asof_nbr_mean_duration AS nbr_mean_duration, asof_nbr_mean_duration * asof_nbr_mean_burden AS nbr_mean_severity, asof_quantile_fallback_level <> 'global' OR asof_quantile_support >= 5 AS coverage_flag FROM f)
SELECT event_id, snapshot_date, asof_quantile_fallback_level, asof_quantile_support, asof_planned_support, asof_retrieval_fallback, coverage_flag, {', '.join(f'round({n}::DOUBLE, 6) AS {n}' for n in _ROUNDED)} FROM x""")
