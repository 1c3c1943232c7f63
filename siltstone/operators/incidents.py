"""The incident contract and the adapters that bind the available tables to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.expressions import noisy_or_trust
from siltstone.sources.tables import table

#: Weights of the trust score: negative duration, missing end, missing place, unknown priority.
TRUST_WEIGHTS = (0.30, 0.40, 0.30, 0.30)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents: one row an order, its last shipment as the end, lasting whole days.

    Only the columns that a query uses are read; lineitem is aggregated before it is joined.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_shipdate").alias("end_ts"), F.min("l_suppkey").alias("junction"), F.bool_or(F.col("l_returnflag") == "R").alias("closure"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey", F.col("o_orderdate").alias("start_ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("corridor"), F.col("r_name").alias("zone"))
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("event_cause"), "corridor", "zone")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, "event_id", "left")
    duration = F.datediff("end_ts", "start_ts").cast("double")
    rows = rows.withColumn("duration", duration).withColumn("is_censored", F.col("end_ts").isNull() | (F.col("status") == "O")).withColumn("closure", F.coalesce("closure", F.lit(False)))
    negative, no_end, no_place, vague = F.coalesce(F.col("duration") < 0, F.lit(False)), F.col("end_ts").isNull(), F.col("junction").isNull(), F.col("priority") == "4-NOT SPECIFIED"
    trust = noisy_or_trust(list(zip((negative, no_end, no_place, vague), TRUST_WEIGHTS, strict=True)))
    return rows.select("event_id", "start_ts", "end_ts", "status", "priority", "price", "event_cause", "corridor", "zone", "junction", "closure", "duration", "is_censored", trust.alias("trust"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents: the value is the duration in minutes, users are junctions, t counts microseconds."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        ts.alias("ts"),
        F.unix_micros(ts).alias("t"),
        F.col("event_type").alias("event_cause"),
        (F.col("user_id") % 10).alias("corridor"),
        (F.col("user_id") % 5).alias("zone"),
        F.col("user_id").alias("junction"),
        F.col("value").alias("duration"),
        (F.col("event_type") == "error").alias("is_censored"),
        k.alias("k"),
        (k < 20).alias("closure"),
        ((k + 1) / 100.0).alias("trust"),
    )


def junctions(clicks: DataFrame) -> DataFrame:
    """A dimension of junctions: a made-up place, counts, mean duration and burden."""
    return clicks.groupBy("junction").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("duration").alias("mean_duration"),
        F.sum(F.col("trust") * F.log1p("duration")).alias("burden"),
        F.max("corridor").alias("corridor"),
        F.max("zone").alias("zone"),
        F.avg(F.col("closure").cast("double")).alias("closure_rate"),
    ).withColumns({"lat": 12 + (F.col("junction") * 7 % 31) * 0.01, "lon": 77 + (F.col("junction") * 11 % 37) * 0.01})


def early(clicks: DataFrame, share: float) -> DataFrame:
    """clicks with early: whether a row lies in the first share of the time that they span."""
    span = clicks.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    cut = F.col("low") + F.floor((F.col("high") - F.col("low")) * F.lit(share))
    return clicks.crossJoin(F.broadcast(span)).withColumn("early", F.col("t") <= cut).drop("low", "high")


def early_sql(share: float) -> str:
    return f"t <= (SELECT min(t) + CAST(floor((max(t) - min(t)) * {share}::DOUBLE) AS BIGINT) FROM clicks)"


#: The same adapters as common table expressions.
SHIPMENTS_SQL = """
lines AS (SELECT l_orderkey AS event_id, max(l_shipdate) AS end_ts, min(l_suppkey) AS junction, bool_or(l_returnflag = 'R') AS closure FROM lineitem GROUP BY l_orderkey),
shipments0 AS (
  SELECT o.o_orderkey AS event_id, o.o_orderdate AS start_ts, l.end_ts, o.o_orderstatus AS status, o.o_orderpriority AS priority, o.o_totalprice AS price,
         c.c_mktsegment AS event_cause, n.n_name AS corridor, r.r_name AS zone, l.junction, coalesce(l.closure, false) AS closure,
         CAST(date_diff('day', o.o_orderdate, l.end_ts) AS DOUBLE) AS duration, (l.end_ts IS NULL OR o.o_orderstatus = 'O') AS is_censored
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN lines l ON o.o_orderkey = l.event_id),
shipments AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN duration < 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN end_ts IS NULL THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END
         * CASE WHEN junction IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN priority = '4-NOT SPECIFIED' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)) AS trust
  FROM shipments0)"""
CLICKS_SQL = """
clicks AS (
  SELECT event_id, ts, epoch_us(ts) AS t, event_type AS event_cause, user_id % 10 AS corridor, user_id % 5 AS zone, user_id AS junction, value AS duration,
         event_type = 'error' AS is_censored, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) < 20 AS closure,
         (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) / 100.0::DOUBLE AS trust
  FROM events)"""
JUNCTIONS_SQL = (
    CLICKS_SQL
    + """,
junctions AS (
  SELECT junction, count(*) AS n, avg(duration) AS mean_duration, sum(trust * ln(1 + duration)) AS burden, max(corridor) AS corridor, max(zone) AS zone,
         avg(CAST(closure AS DOUBLE)) AS closure_rate, 12 + (junction * 7 % 31) * 0.01::DOUBLE AS lat, 77 + (junction * 11 % 37) * 0.01::DOUBLE AS lon
  FROM clicks GROUP BY junction)"""
)
