"""Queries: rates of corridors and junctions shrunk to their zones', with intervals, and excitation of junctions by what is near."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import incidents as I
from siltstone.operators import shrinkage as H
from siltstone.plans.catalogue import register
from siltstone.plans.q_core import r6

BETAS = (0.2, 1.0, 5.0)
COLUMNS = ("beta", "raw_mu", "raw_alpha", "mu_weight", "alpha_weight", "mu", "alpha", "branching", "intensity", "fragility", "practical", "low", "high")


def rates_sql(source: str, betas, least: int, draws: int, strength: float | None = None, reach: float = 1e9) -> str:
    """SQL of the same result over src(key, grp, h, own, m): one row an event of a key."""
    weight = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in H.POISSON)

    def solve(table: str) -> str:
        return f"""SELECT *, CASE WHEN at_floor THEN floor0 ELSE (n - a1 * i1) / span END AS mu, CASE WHEN at_floor THEN (CASE WHEN i2 > 0 THEN greatest(0, (y - floor0 * i1) / i2) ELSE 0 END) ELSE a1 END AS alpha
FROM (SELECT *, (n - a1 * i1) / span < floor0 AS at_floor FROM (SELECT *, {H.FLOOR} * n / span AS floor0, greatest(0, CASE WHEN span * i2 - i1 * i1 > 1e-12 * span * i2 THEN (span * y - i1 * n) / (span * i2 - i1 * i1) ELSE 0 END) AS a1 FROM {table} WHERE span > 0))"""

    def between(x: str, by: str) -> str:
        keys, on = ("grp, ", "GROUP BY grp") if by else ("", "")
        join = "JOIN t USING (grp)" if by else ", t"
        return f"""{x}_{by or 'all'} AS (WITH k AS (SELECT grp, {x} AS x, {x}_var AS v FROM held WHERE fitted),
t AS (SELECT {keys}CASE WHEN count(*) > 1 THEN greatest(0, (sum(x * x / v) - sum(x / v) * sum(x / v) / sum(1 / v) - (count(*) - 1)) / (sum(1 / v) - sum(1 / v / v) / sum(1 / v))) END AS tau FROM k {on})
SELECT {keys}sum(x / (v + coalesce(tau, 0))) / sum(1 / (v + coalesce(tau, 0))) AS mean, any_value(tau) AS tau FROM k {join} {on})"""

    def own_weight(x: str) -> str:
        return f"n / (n + {strength}::DOUBLE)" if strength is not None else f"coalesce({x}_grp.tau / ({x}_grp.tau + {x}_var), 1.0)"

    return f"""WITH {source}, times AS MATERIALIZED (SELECT key, h, sum(own) AS c, sum(m) AS m FROM src GROUP BY key, h), ends AS (SELECT min(h) AS start, max(h) AS stop FROM src), groups AS (SELECT key, min(grp) AS grp FROM src GROUP BY key),
b AS (SELECT unnest({[float(x) for x in betas]}::DOUBLE[]) AS beta),
kernel AS (SELECT x.key, b.beta, x.h, any_value(x.c) AS c, any_value(x.m) AS m, coalesce(sum(o.m * exp(-b.beta * (x.h - o.h))), 0) AS A FROM times x CROSS JOIN b LEFT JOIN times o ON o.key = x.key AND o.h < x.h AND x.h - o.h < {reach} GROUP BY x.key, b.beta, x.h),
seg AS (SELECT *, coalesce(lead(h) OVER o, stop) - h AS dt, CASE WHEN lag(h) OVER o IS NULL THEN h - start ELSE 0 END AS lead_in FROM kernel, ends WINDOW o AS (PARTITION BY key, beta ORDER BY h)),
moments AS MATERIALIZED (SELECT key, beta, CAST(floor(h / {H.BLOCK}) AS BIGINT) AS block, sum(c)::DOUBLE AS n, sum(dt + lead_in) AS span, sum((A + m) * (1 - exp(-beta * dt)) / beta) AS i1, sum((A + m) * (A + m) * (1 - exp(-2 * beta * dt)) / (2 * beta)) AS i2, sum(c * A) AS y, sum(m * exp(-beta * (stop - h))) AS now FROM seg GROUP BY key, beta, block),
totals AS (SELECT key, grp, beta, sum(n) AS n, sum(span) AS span, sum(i1) AS i1, sum(i2) AS i2, sum(y) AS y, sum(now) AS now FROM moments JOIN groups USING (key) GROUP BY ALL),
solved AS ({solve('totals')}), gained AS (SELECT *, n >= {least} AS fitted, 2 * (mu * n + alpha * y) - (mu * mu * span + 2 * mu * alpha * i1 + alpha * alpha * i2) AS gain FROM solved),
best AS (SELECT grp, beta FROM (SELECT grp, beta, row_number() OVER (PARTITION BY grp ORDER BY round(sum(CASE WHEN fitted THEN gain ELSE 0 END), 9) DESC, round(sum(gain), 9) DESC, beta) AS place FROM gained GROUP BY grp, beta) WHERE place = 1),
fits AS MATERIALIZED (SELECT gained.* FROM gained JOIN best USING (grp, beta)),
drawn AS (SELECT m.*, draw, ('0x' || substr(md5(m.key || '|' || m.block || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM moments m JOIN fits f ON f.key = m.key AND f.beta = m.beta AND f.fitted, (SELECT unnest(range(1, {draws} + 1)) AS draw)),
weighed AS (SELECT key, draw, sum(w * n) AS n, sum(w * span) AS span, sum(w * i1) AS i1, sum(w * i2) AS i2, sum(w * y) AS y FROM (SELECT *, {weight} AS w FROM drawn) WHERE w > 0 GROUP BY key, draw),
refits AS MATERIALIZED ({solve('weighed')}), variances AS (SELECT key, greatest(coalesce(var_samp(mu), 0), 1e-12) AS mu_var, greatest(coalesce(var_samp(alpha), 0), 1e-12) AS alpha_var FROM refits GROUP BY key),
held AS (SELECT * FROM fits LEFT JOIN variances USING (key)), {between('mu', 'grp')}, {between('mu', '')}, {between('alpha', 'grp')}, {between('alpha', '')},
prior AS (SELECT held.*, CASE WHEN fitted THEN {own_weight('mu')} ELSE 0 END AS mw, CASE WHEN fitted THEN {own_weight('alpha')} ELSE 0 END AS aw, coalesce(mu_grp.mean, mu_all.mean, n / span) AS mp, coalesce(alpha_grp.mean, alpha_all.mean, 0) AS ap
 FROM held LEFT JOIN mu_grp ON mu_grp.grp = held.grp LEFT JOIN alpha_grp ON alpha_grp.grp = held.grp LEFT JOIN mu_all ON true LEFT JOIN alpha_all ON true),
final AS (SELECT *, greatest(mw * mu + (1 - mw) * mp, {H.FLOOR} * n / span, 1e-6) AS smu, aw * alpha + (1 - aw) * ap AS salpha FROM prior),
bounds AS (SELECT p.key, quantile_cont(f, 0.05) AS low, quantile_cont(f, 0.95) AS high FROM (SELECT p.key, (aw * r.alpha + (1 - aw) * ap) * p.now / greatest(mw * r.mu + (1 - mw) * mp, {H.FLOOR} * p.n / p.span, 1e-6) AS f FROM refits r JOIN prior p ON p.key = r.key) p GROUP BY p.key),
result AS (SELECT final.key, grp, CAST(n AS BIGINT) AS n, CASE WHEN fitted THEN 'key' ELSE 'group' END AS level, beta, mu AS raw_mu, alpha AS raw_alpha, mw AS mu_weight, aw AS alpha_weight, smu AS mu, salpha AS alpha, salpha / beta AS branching, smu + salpha * now AS intensity, salpha * now / smu AS fragility,
 least(salpha * now / smu, 100) AS practical, coalesce(low, 0.3 * salpha * now / smu) AS low, coalesce(high, 3 * salpha * now / smu) AS high, smu >= {H.RELIABLE} * n / span AS reliable FROM final LEFT JOIN bounds ON bounds.key = final.key)"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS)


def corridor_fragility(spark, sf):
    """How far the rate of each corridor is now above its base, shrunk to the zone's, with the interval of 100 refits."""
    out = H.shrunk_rates(I.clicks(spark, sf), "corridor", "zone", "t", F.col("trust"), BETAS)
    return out.select("corridor", F.col("group").alias("zone"), "n", "level", "reliable", *[r6(c).alias(c) for c in COLUMNS])


SOURCE = f"{I.CLICKS_SQL}, src AS (SELECT corridor AS key, CAST(zone AS VARCHAR) AS grp, t / 3600000000.0::DOUBLE AS h, 1 AS own, trust AS m FROM clicks)"
register("corridor_fragility", corridor_fragility, f"{rates_sql(SOURCE, BETAS, 20, 100)} SELECT key AS corridor, grp AS zone, n, level, reliable, {ROUNDED} FROM result")


def junction_fragility(spark, sf):
    """The same of each junction, with the fixed strength of ten events; junctions with fewer than 60 take their zone's mean."""
    out = H.shrunk_rates(I.clicks(spark, sf), "junction", "zone", "t", F.col("trust"), BETAS, least=60, draws=40, strength=10.0)
    return out.select("junction", F.col("group").alias("zone"), "n", "level", "reliable", *[r6(c).alias(c) for c in COLUMNS])


SOURCE = f"{I.CLICKS_SQL}, src AS (SELECT junction AS key, CAST(zone AS VARCHAR) AS grp, t / 3600000000.0::DOUBLE AS h, 1 AS own, trust AS m FROM clicks)"
register("junction_fragility", junction_fragility, f"{rates_sql(SOURCE, BETAS, 60, 40, 10.0)} SELECT key AS junction, grp AS zone, n, level, reliable, {ROUNDED} FROM result")


SIGMA, REACH = 2.0, 6.0  # km; beyond REACH an event's weight is below 5 %


def spatial_excitation(spark, sf):
    """For each junction the rate of its own events as excited by all events within 6 km, weighted by distance, and the test
    against a constant rate."""
    c = I.clicks(spark, sf)
    places = I.junctions(c).select("junction", "lat", "lon")
    out = H.nearby_rates(c.select("junction", "t"), places, "junction", "t", REACH, SIGMA, BETAS)
    preferred = (F.round("p_value", 6) < 0.05) & (F.col("alpha") > 0)
    return out.select("junction", F.col("n").cast("long").alias("n"), "beta", preferred.alias("excited"), *[r6(x).alias(x) for x in ("mu", "alpha", "branching", "p_value")], *[F.round(x, 4).alias(x) for x in ("ll", "ll_poisson", "lr")])


NEAR = f"""{I.JUNCTIONS_SQL}, d AS (SELECT a.junction AS centre, b.junction, 2 * 6371 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) AS km FROM junctions a, junctions b),
src AS (SELECT d.centre AS key, 'all' AS grp, t / 3600000000.0::DOUBLE AS h, CAST(d.centre = c.junction AS INTEGER) AS own, exp(-km / {SIGMA}::DOUBLE) AS m FROM clicks c JOIN d ON d.junction = c.junction AND km <= {REACH})"""
register("spatial_excitation", spatial_excitation, f"""{rates_sql(NEAR, BETAS, 20, 1, reach=150)}, place AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(gain, 9) DESC, beta) AS place FROM gained), f AS (SELECT * FROM place WHERE place.place = 1),
l AS (SELECT k.key, sum(k.c * ln(f.mu + f.alpha * k.A)) FILTER (k.c > 0) AS logs FROM kernel k JOIN f ON f.key = k.key AND f.beta = k.beta GROUP BY k.key),
q AS (SELECT f.*, logs - mu * span - alpha * i1 AS ll, n * ln(n / span) - n AS ll_poisson FROM f JOIN l ON l.key = f.key), v AS (SELECT *, greatest(0, 2 * (ll - ll_poisson)) AS lr FROM q)
SELECT key AS junction, CAST(n AS BIGINT) AS n, beta, round(exp(-lr / 2), 6) < 0.05 AND alpha > 0 AS excited, round(mu, 6) AS mu, round(alpha, 6) AS alpha, round(alpha / beta, 6) AS branching, round(exp(-lr / 2), 6) AS p_value, round(ll, 4) AS ll, round(ll_poisson, 4) AS ll_poisson, round(lr, 4) AS lr FROM v""")
