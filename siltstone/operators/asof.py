"""The point-in-time feature matrix: what was known at the last snapshot before each event's day.

Snapshots lie at the start of each day; an event of day D reads the one of day D - 1, so it sees events of days
up to D - 2. All history is summed into small cells first (durations by tenths of a minute, marks and kernels by
key and day, retrieval features by their values), and only those cells meet the snapshots: the facts are read,
summed with map-side combine, and joined once with states of keys and days.

Events have event_id, t (long microseconds), event_cause, corridor, zone, junction, priority, duration, is_censored,
closure, planned and trust. A corridor lies in one zone. A null cause or corridor belongs to no stratum of its own:
it falls back to wider ones. Without history all counts are 0 and the quantiles 60, 120 and 180.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .temporal import DAY, HOUR

LAG, MIN_SUPPORT, MIN_CASES = 2, 5, 3
DECAY, BETA = 0.05, 0.1  # a day, an hour
KERNEL_DAYS = 18  # e^(-24 * BETA * 18) is below a double's precision
LEVELS = {"cause_corridor": ("event_cause", "corridor"), "cause_only": ("event_cause",), "corridor_only": ("corridor",), "global": ()}
NUMERIC, PLACES, OTHERS = ("hour", "dow", "closure"), ((), ("zone",), ("zone", "corridor")), ((), ("event_cause",), ("priority",), ("event_cause", "priority"))
CATEGORIES = ("event_cause", "corridor", "zone", "priority")


def tenths(duration: Column) -> Column:
    return F.floor(duration * 10 + 0.5) / 10


def _resolved(events: DataFrame) -> DataFrame:
    return events.where(~F.col("is_censored") & (F.col("duration") > 0)).withColumn("v", tenths(F.col("duration")))


def _ahead(cells: DataFrame, last: DataFrame) -> DataFrame:
    """cells once for each snapshot that sees them; day becomes the day of the events that ask."""
    return cells.crossJoin(F.broadcast(last)).where(F.col("day") + LAG <= F.col("last")).withColumn("day", F.explode(F.sequence(F.col("day") + LAG, F.col("last")))).drop("last")


def duration_states(events: DataFrame, last: DataFrame) -> DataFrame:
    """level, event_cause, corridor, day: support, quantiles, survival shares and restricted mean of past durations."""
    strata = [F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in ("event_cause", "corridor")]) for level, keys in LEVELS.items()]
    cells = _resolved(events).groupBy("event_cause", "corridor", "day", "v").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("day", "v", "n", F.explode(F.array(*strata)).alias("s")).groupBy("s.level", "s.event_cause", "s.corridor", "day", "v").agg(F.sum("n").alias("n"))
    v, n = F.col("v"), F.col("n")
    share = lambda h: (F.sum(F.when(v > h, n).otherwise(0)) / F.sum(n)).alias(f"s{h}")
    return _ahead(cells, last).groupBy("level", "event_cause", "corridor", "day").agg(
        F.sum(n).alias("support"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)), n).alias("p"), share(60), share(120), share(180), (F.sum(n * F.least(v, F.lit(180.0))) / F.sum(n)).alias("rmst")
    )


def fallback_durations(asked: DataFrame, states: DataFrame) -> DataFrame:
    """asked (day, event_cause, corridor) with the first level of at least MIN_SUPPORT durations."""
    out = asked
    for level, keys in LEVELS.items():
        fields = [F.struct("support", "p", "s60", "s120", "s180", "rmst").alias(level)]
        out = out.join(states.where(F.col("level") == level).select("day", *keys, *fields), ["day", *keys], "left")
    enough = [(level, F.col(f"{level}.support") >= MIN_SUPPORT) for level in LEVELS]
    first = F.coalesce(*[F.when(ok, F.lit(level)) for level, ok in enough], F.lit("global"))
    chosen = F.coalesce(*[F.when(ok, F.col(level)) for level, ok in enough], F.col("global"))
    curve = F.coalesce(*[F.when(ok, F.col(level)) for level, ok in enough], F.col("cause_corridor"))
    out = out.select(*asked.columns, first.alias("level"), chosen.alias("chosen"), curve.alias("curve"))
    quantiles = [F.coalesce(F.col("chosen.p")[i], F.lit(d)).alias(name) for i, (name, d) in enumerate((("p50", 60.0), ("p80", 120.0), ("p95", 180.0)))]
    survival = [F.coalesce(F.col(f"curve.{c}"), F.lit(d)).alias(c) for c, d in (("s60", 0.5), ("s120", 0.5), ("s180", 0.5), ("rmst", 90.0))]
    return out.select(*asked.columns, "level", F.coalesce("chosen.support", F.lit(0)).alias("support"), *quantiles, *survival)


def _decayed(first: Column) -> Column:
    """Sum of weights that grow by e^DECAY a day from the first day on."""
    return F.sum(F.exp(DECAY * (F.col("t") / DAY - first)))


def _scale(first: Column) -> Column:
    return F.exp(-DECAY * (F.col("day") - 1 - first))


def burstiness(events: DataFrame) -> DataFrame:
    """corridor, day, burst: deviation over mean of the gaps in the 24 hours up to the corridor's last event of the day."""
    by_day = W.partitionBy("corridor").orderBy("day")
    ends = events.groupBy("corridor", "day").agg(F.max("t").alias("end")).withColumn("before", F.lag("end").over(by_day))
    rows = events.select("corridor", "day", "t", F.lag("t").over(W.partitionBy("corridor", "day").orderBy("t", "event_id")).alias("previous"))
    rows = rows.join(ends.select("corridor", "day", "before"), ["corridor", "day"]).withColumn("previous", F.coalesce("previous", "before"))
    rows = rows.select("corridor", "t", "previous", F.explode(F.array("day", F.col("day") + 1)).alias("day"))
    gaps = rows.join(ends.select("corridor", "day", "end"), ["corridor", "day"]).where(F.col("previous") >= F.col("end") - DAY)
    gap = (F.col("t") - F.col("previous")) / 60e6
    return gaps.groupBy("corridor", "day").agg(F.coalesce(F.stddev_samp(gap) / (F.avg(gap) + 1e-6), F.lit(0.0)).alias("burst"))


def corridor_states(events: DataFrame, span: DataFrame, states: DataFrame) -> DataFrame:
    """corridor, day: rate, burden, kernel sum, burstiness, and the means of the zone's other corridors."""
    rows = events.where("corridor is not null").crossJoin(F.broadcast(span))
    kernel = F.sum(F.exp(-BETA * ((F.col("day") + 1) * DAY - F.col("t")) / HOUR))
    daily = rows.groupBy("corridor", "day").agg(F.count(F.lit(1)).alias("n"), _decayed(F.col("first")).alias("w"), kernel.alias("s"))
    daily = daily.join(burstiness(events), ["corridor", "day"], "left").withColumn("burst", F.coalesce("burst", F.lit(0.0)))
    grid = daily.select("corridor").distinct().crossJoin(F.broadcast(span)).select("corridor", "first", F.explode(F.sequence("first", "last")).alias("day"))
    order = W.partitionBy("corridor").orderBy("day")
    past = order.rowsBetween(W.unboundedPreceding, -LAG)
    back = reduce(Column.__add__, [F.coalesce(F.lag("s", LAG + j).over(order), F.lit(0.0)) * F.exp(F.lit(-24.0 * BETA * j)) for j in range(KERNEL_DAYS + 1)])
    state = grid.join(daily, ["corridor", "day"], "left").select(
        "corridor", "day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("rate"), (F.coalesce(F.sum("w").over(past), F.lit(0.0)) * _scale(F.col("first"))).alias("burden"), back.alias("kernel"), F.coalesce(F.last("burst", True).over(past), F.lit(0.0)).alias("burst")
    )
    member = events.where("corridor is not null").select("zone", "corridor").distinct()
    pairs = member.join(member.withColumnRenamed("corridor", "other"), "zone").where("corridor <> other").select("corridor", "other").distinct()
    medians = states.where("level = 'corridor_only'").select(F.col("corridor").alias("other"), "day", F.col("p")[0].alias("median"))
    others = state.select(F.col("corridor").alias("other"), "day", F.col("burden").alias("b")).join(medians, ["other", "day"], "left")
    near = pairs.join(others, "other").groupBy("corridor", "day").agg(F.avg("b").alias("near_burden"), F.avg("median").alias("near_duration"))
    return state.join(near, ["corridor", "day"], "left")


def junction_states(events: DataFrame, span: DataFrame) -> DataFrame:
    """junction, day, junction_burden for the days that have events."""
    daily = events.crossJoin(F.broadcast(span)).groupBy("junction", "day").agg(_decayed(F.col("first")).alias("w"), F.max("first").alias("first"))
    past = W.partitionBy("junction").orderBy("day").rangeBetween(W.unboundedPreceding, -LAG)
    return daily.select("junction", "day", (F.coalesce(F.sum("w").over(past), F.lit(0.0)) * _scale(F.col("first"))).alias("junction_burden"))


def rates(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fitted on train alone: (corridor, mu, alpha), (event_cause, tau) and one row of the values for all others."""
    rows = _resolved(train)
    by_value = rows.groupBy("event_cause", "v").agg(F.count(F.lit(1)).alias("n"))
    days = F.greatest((F.max("t") - F.min("t")) / DAY, F.lit(1.0))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), days.alias("days"), F.count_distinct("corridor").alias("corridors"))
    mu = F.col("n") / (F.col("days") * F.greatest("corridors", F.lit(1)))
    tau = by_value.agg(F.percentile("v", F.lit(0.75), F.col("n")).alias("tau"))
    any_ = whole.select(F.when(F.col("n") > 0, mu).otherwise(0.01).alias("any_mu"), F.when(F.col("n") > 0, F.least(F.lit(0.2), mu * 0.5)).otherwise(0.05).alias("any_alpha"), "days").crossJoin(tau.select(F.coalesce("tau", F.lit(60.0)).alias("any_tau")))
    of_corridor = rows.where("corridor is not null").groupBy("corridor").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(any_)).withColumn("mu", F.col("n") / F.col("days")).select("corridor", "mu", F.least(F.lit(0.3), F.col("mu") * 0.4).alias("alpha"))
    of_cause = by_value.where("event_cause is not null").groupBy("event_cause").agg(F.sum("n").alias("n"), F.percentile("v", F.lit(0.75), F.col("n")).alias("tau")).where(F.col("n") >= MIN_SUPPORT).select("event_cause", "tau")
    return of_corridor, of_cause, any_.drop("days")


def _similar(column: str, other: str) -> Column:
    return 1 - F.least(F.abs(F.col(column) - F.col(other)) / F.col(f"range_{column}"), F.lit(1.0))


def retrieval_states(events: DataFrame, last: DataFrame) -> DataFrame:
    """Support, mean and greatest similarity to the planned events of the past, for each combination of features.

    The mean is a sum over features, each from the counts of its values. For the greatest, a planned event counts
    under each pattern of categories that it shares with a query, where only the best hour, day and closure matter:
    at most 336 combinations a pattern, whatever the number of events.
    """
    keys = ["day", *NUMERIC, *CATEGORIES]
    asked = events.select(*keys).distinct()
    planned = events.where("planned")
    limits = _ahead(events.groupBy("day").agg(*[f(c).alias(f"{n}_{c}") for c in NUMERIC for n, f in (("low", F.min), ("high", F.max))]), last).groupBy("day")
    width = lambda c: F.max(f"high_{c}") - F.min(f"low_{c}")
    ranges = limits.agg(*[F.when(width(c) > 0, width(c)).otherwise(1).alias(f"range_{c}") for c in NUMERIC])
    support = _ahead(planned.groupBy("day").agg(F.count(F.lit(1)).alias("n")), last).groupBy("day").agg(F.sum("n").alias("cases"))
    out = asked
    for c in (*NUMERIC, *CATEGORIES):
        counts = _ahead(planned.groupBy("day", F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")), last).groupBy("day", "value").agg(F.sum("n").alias("n"))
        if c in NUMERIC:
            pairs = asked.select("day", c).distinct().join(counts, "day").join(ranges, "day")
            match = pairs.groupBy("day", c).agg(F.sum(F.col("n") * _similar(c, "value")).alias(f"m_{c}"))
        else:
            match = counts.select("day", F.col("value").alias(c), F.col("n").alias(f"m_{c}"))
        out = out.join(match, ["day", c], "left")
    total = reduce(Column.__add__, [F.coalesce(F.col(f"m_{c}"), F.lit(0)) for c in (*NUMERIC, *CATEGORIES)])
    features = len(NUMERIC) + len(CATEGORIES)
    means = out.join(support, "day").select(*keys, "cases", (total / features / F.col("cases")).alias("mean_sim"))

    patterns = [(*p, *o) for p in PLACES for o in OTHERS]
    as_key = F.explode(F.array(*[F.struct(F.lit(i).alias("pattern"), F.lit(len(p)).alias("same"), F.array(*[F.col(c).cast("string") for c in p] or [F.lit("")]).alias("key")) for i, p in enumerate(patterns)])).alias("p")
    cells = planned.groupBy(*NUMERIC, *CATEGORIES).agg(F.min("day").alias("since")).select(*[F.col(c).alias(f"{c}_p") for c in NUMERIC], "since", as_key)
    cells = cells.where(~F.exists("p.key", lambda x: x.isNull())).groupBy(*[f"{c}_p" for c in NUMERIC], "p.pattern", "p.same", "p.key").agg(F.min("since").alias("since"))
    queries = asked.select("day", *NUMERIC, as_key).select("day", *NUMERIC, "p.pattern", "p.key").distinct()
    numeric = reduce(Column.__add__, [_similar(c, f"{c}_p") for c in NUMERIC])
    best = queries.join(cells, ["pattern", "key"]).where(F.col("since") + LAG <= F.col("day")).join(ranges, "day").groupBy("day", *NUMERIC, "pattern", "key").agg(F.max((numeric + F.col("same")) / features).alias("sim"))
    spread = asked.select(*keys, as_key).select(*keys, "p.pattern", "p.key")
    top = spread.join(best, ["day", *NUMERIC, "pattern", "key"]).groupBy(*keys).agg(F.max("sim").alias("max_sim"))
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    return means.alias("a").join(top.alias("b"), same).select("a.*", "b.max_sim")


def feature_matrix(events: DataFrame, train: DataFrame) -> DataFrame:
    """event_id and the 38 columns of what was known; train is the part of events that rates are fitted on."""
    rows = events.withColumns({"day": F.floor(F.col("t") / DAY), "hour": F.floor(F.col("t") / HOUR) % 24, "closure": F.col("closure").cast("int")}).withColumn("dow", (F.col("day") + 3) % 7)
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    last = span.select("last")
    states = duration_states(rows, last)
    durations = fallback_durations(rows.select("day", "event_cause", "corridor").distinct(), states)
    of_corridor, of_cause, any_ = rates(train)
    cases = retrieval_states(rows, last)

    def join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """Keys may be null; those of the right side get other names."""
        named = right.withColumnsRenamed({k: f"of_{k}" for k in keys})
        return left.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]), "left").drop(*[f"of_{k}" for k in keys])

    out = rows.select("event_id", "trust", "junction", "day", *NUMERIC, *CATEGORIES).crossJoin(F.broadcast(span)).crossJoin(F.broadcast(any_))
    for right, keys in ((durations, ["day", "event_cause", "corridor"]), (corridor_states(rows, span, states), ["corridor", "day"]), (junction_states(rows, span), ["junction", "day"]), (of_corridor, ["corridor"]), (of_cause, ["event_cause"]), (cases, ["day", *NUMERIC, *CATEGORIES])):
        out = join(out, right, keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mu, alpha = F.coalesce("mu", "any_mu"), F.coalesce("alpha", "any_alpha")
    out = out.select(
        "event_id", zero("trust").alias("trust"), F.date_from_unix_date(F.greatest(F.col("day") - 1, F.col("first")).cast("int")).cast("string").alias("snapshot_date"),
        *[F.col(c).alias(f"asof_{c}_duration") for c in ("p50", "p80", "p95")], *[F.col(f"s{h}").alias(f"asof_surv_prob_{h}") for h in (60, 120, 180)], F.col("rmst").alias("asof_rmst_180"),
        F.col("level").alias("asof_quantile_fallback_level"), F.col("support").alias("asof_quantile_support"), zero("burden").alias("asof_corridor_burden"), zero("junction_burden").alias("asof_junction_burden"),
        (zero("burden") / (1 + zero("junction_burden"))).alias("asof_obi_proxy"), zero("rate").alias("asof_corridor_event_rate"), zero("near_burden").alias("asof_nbr_mean_burden"), F.coalesce("near_duration", "p50").alias("asof_nbr_mean_duration"),
        mu.alias("mu"), (mu + alpha * zero("kernel")).alias("asof_hawkes_intensity"), zero("burst").alias("asof_burstiness"), F.when(F.col("p80") > F.coalesce("tau", "any_tau"), 1.0).otherwise(0.0).alias("high"),
        zero("cases").alias("asof_retrieval_n_eff"), zero("mean_sim").alias("asof_retrieval_mean_sim"), zero("max_sim").alias("asof_retrieval_max_sim"), F.coalesce("cases", F.lit(0)).alias("asof_planned_support"),
    )
    c = F.col
    out = out.withColumns({
        "asof_fragility_proxy": c("mu") + 0.5 * c("asof_hawkes_intensity"), "asof_branching_ratio_proxy": F.least(c("asof_hawkes_intensity") / (c("mu") + 1e-6), F.lit(3.0)),
        "asof_retrieval_confidence": c("asof_retrieval_n_eff") / (c("asof_retrieval_n_eff") + 2) * c("asof_retrieval_mean_sim") * c("asof_retrieval_max_sim"), "asof_ims_proxy": c("asof_retrieval_mean_sim") * F.log1p("asof_retrieval_n_eff"),
        "asof_retrieval_fallback": F.when(c("asof_planned_support") >= MIN_CASES, "exact").otherwise("low_support"),
    })
    return out.withColumns({
        "obi_x_fragility": c("asof_obi_proxy") * c("asof_fragility_proxy"), "retrieval_x_risk": c("asof_retrieval_confidence") * c("high"), "fragility_x_duration": c("asof_fragility_proxy") * c("asof_p50_duration"), "trust_x_confidence": c("trust") * c("asof_retrieval_confidence"),
        "hotspot_x_duration": c("asof_corridor_burden") * c("asof_p50_duration"), "hawkes_x_obi": c("asof_hawkes_intensity") * c("asof_obi_proxy"), "nbr_mean_obi": c("asof_nbr_mean_burden"), "nbr_mean_fragility": c("asof_fragility_proxy"), "nbr_mean_duration": c("asof_nbr_mean_duration"),
        "nbr_mean_severity": c("asof_nbr_mean_duration") * c("asof_nbr_mean_burden"), "coverage_flag": (c("asof_quantile_fallback_level") != "global") | (c("asof_quantile_support") >= MIN_SUPPORT),
    }).drop("trust", "mu", "high")
