"""Small decisions and reports over summaries: matching of classes, allocation variants, re-ranking, audits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Edges that a task settles at once.
LOCAL_EDGES = 1_000_000


def closest_class(value: Column, classes: Sequence[str]) -> Column:
    """The first class that holds the value or is held by it, else the first that holds a word of the value (words
    in turn), else the first class; letters' case does not count. Null stays null."""
    low = F.lower(value)
    names = F.array(*[F.lit(c) for c in classes])
    either = F.filter(names, lambda c: F.contains(F.lower(c), low) | F.contains(low, F.lower(c)))
    by_word = F.flatten(F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.filter(names, lambda c: F.contains(F.lower(c), w))))
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(either, F.lit(1)), F.try_element_at(by_word, F.lit(1)), F.lit(classes[0])))


def with_fallback(rows: DataFrame, first: Column, otherwise: Column, least: int = 10) -> DataFrame:
    """The rows that `first` takes; where these are fewer than `least`, those that either takes."""
    enough = rows.agg((F.count_if(first) >= least).alias("enough_first"))
    return rows.crossJoin(F.broadcast(enough)).where(F.coalesce(first, F.lit(False)) | (~F.col("enough_first") & F.coalesce(otherwise, F.lit(False)))).drop("enough_first")


def dummies(rows: DataFrame, column: str, values: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and a 0/1 column named column=value for each value."""
    return rows.select(*keep, *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{column}={v}") for v in values])


def aligned(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both frames with the union of their columns, 0 where a frame lacks one, and is_train."""
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)), allowMissingColumns=True)
    return both.na.fill(0)


def demand_units(dis: Column, p80: Column, closure: Column, branching: Column) -> dict[str, Column]:
    """The demand score of a place and the units that it asks for."""
    ods = dis * (1 + F.least(p80, F.lit(360.0)) / 120) * F.when(closure, 1.5).otherwise(1.0) * (1 + branching)
    up = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(c))).cast("int")
    officers = up(ods / 30, 1, 25)
    return {
        "ods": ods,
        "officers": officers,
        "barricades": up(ods / 20, 0, 40),
        "tow_units": up(ods / 80, 0, 5),
        "supervisors": F.ceil(officers / 6).cast("int"),
        "patrol_vehicles": F.ceil(officers / 4).cast("int"),
        "qru_units": (dis >= 70).cast("int"),
    }


def spans_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with {column}_unit: each column scaled to 0..1 by its range, 0 where all are equal."""
    ends = rows.agg(*[e for c in columns for e in (F.min(c).cast("double").alias(f"{c}_low"), F.max(c).cast("double").alias(f"{c}_high"))])
    unit = {f"{c}_unit": F.when(F.col(f"{c}_high") > F.col(f"{c}_low"), (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low"))).otherwise(0.0) for c in columns}
    return rows.crossJoin(F.broadcast(ends)).withColumns(unit).drop(*[f"{c}_{e}" for c in columns for e in ("low", "high")])


def blended(weights: Mapping[str, float]) -> Column:
    """The weighted sum of columns that spans_of made."""
    return sum((F.lit(w) * F.coalesce(F.col(f"{c}_unit"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def sigmoid_weights(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """rows with weight: the logistic function of the weighted sum of scaled signals less its mean."""
    raw = spans_of(rows, list(weights)).withColumn("raw", blended(weights)).drop(*[f"{c}_unit" for c in weights])
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean_raw")))).withColumn("weight", 1 / (1 + F.exp(F.col("mean_raw") - F.col("raw")))).drop("raw", "mean_raw")


def conformal(train: DataFrame, rows: DataFrame, actual: str, predicted: str, alpha: float = 0.1) -> DataFrame:
    """rows with low and high: the prediction less and plus the train rows' quantile of absolute residuals."""
    residual = train.agg(F.percentile(F.abs(F.col(actual) - F.col(predicted)), F.lit(1 - alpha)).alias("half_width"))
    return rows.crossJoin(F.broadcast(residual)).withColumns({"low": F.col(predicted) - F.col("half_width"), "high": F.col(predicted) + F.col("half_width")})


def plan_variants(plan: DataFrame, key: str, units: Mapping[str, int], budgets: Mapping[str, int], critical: Column, effectiveness: Column, sites: int) -> DataFrame:
    """Each site's units under three postures: as they are; 1.3 times for critical sites and 0.7 times for others;
    the budgets spread evenly. units gives each kind's most at a site."""
    posture = F.explode(F.array(*[F.lit(p) for p in ("plan_A_optimal", "plan_B_conservative", "plan_C_spread")])).alias("plan")
    factor = F.when(critical, 1.3).otherwise(0.7)

    def of(kind: str) -> Column:
        most = F.lit(units[kind])
        even = F.least(F.lit(max(1, budgets[kind] // max(1, sites))), most)
        varied = F.least(F.floor(F.col(kind) * factor + 1e-9).cast("int"), most)
        return F.when(F.col("plan") == "plan_A_optimal", F.col(kind)).when(F.col("plan") == "plan_B_conservative", varied).otherwise(even).cast("int").alias(kind)

    kept = F.when(F.col("plan") == "plan_A_optimal", effectiveness).when(F.col("plan") == "plan_B_conservative", effectiveness * F.when(critical, 1.0).otherwise(0.9)).otherwise(0.3)
    return plan.select("*", posture).select("plan", key, *[of(k) for k in units], kept.alias("effectiveness"))


def decayed_rank(found: DataFrame, query: str, case: str, sim: str, age_days: Column, half_life: float = 180.0) -> DataFrame:
    """found with rank by similarity, decayed similarity, rank by that to 9 places, and how many places a case rose."""
    decayed = F.col(sim) * F.exp(-0.6931471805599453 * F.greatest(F.lit(0.0), age_days) / half_life)
    rows = found.withColumn("decayed", decayed)
    one, two = (F.row_number().over(W.partitionBy(query).orderBy(c.desc(), case)) for c in (F.col(sim), F.round("decayed", 9)))
    return rows.withColumns({"rank_before": one, "rank": two}).withColumn("rose", F.col("rank_before") - F.col("rank"))


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each node of a task's edges a, b other than the smallest that these link it to: the node and that smallest one.
    Edges are taken about LOCAL_EDGES at a time."""
    held: list[pd.DataFrame] = []

    def settled() -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([f[c].to_numpy() for c in ("a", "b") for f in held]), return_inverse=True)
        x, y = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(ids))
        while (root[x] != root[y]).any():
            np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
            while (root[root] != root).any():
                root = root[root]
        moved = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= LOCAL_EDGES:
            yield settled()
            held = []
    if held:
        yield settled()


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame, key: str) -> DataFrame:
    """key and component, the smallest key that paths lead to. A round settles the edges of each task where they are, which
    leaves at most an edge a node, then links each node's larger neighbours to its smallest one and its smaller ones to the
    smallest of these; the number of rounds grows with the logarithm of the longest path. Rounds are written and end
    when every edge leads to the smallest node of its component."""

    def ordered(pairs: DataFrame) -> DataFrame:
        """Each edge once, from its larger end to its smaller one."""
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    kind = edges.schema[a].dataType.simpleString()
    now = ordered(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")))
    while True:
        now = written(now.mapInPandas(_stars, f"a {kind}, b {kind}"), "stars")
        several = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty() and now.select(F.col("b").alias("a")).join(now, "a", "left_semi").isEmpty():
            known = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("x")).distinct()
            return known.join(now, F.col("x") == F.col("a"), "left").select(F.col("x").alias(key), F.coalesce("b", "x").alias("component"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(ordered(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "large_star")
        linked = large.join(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        now = ordered(linked.select("a", F.col("low").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("low").alias("b"))))


def leaks(rows: DataFrame, known: dict[str, Column], at: Column, used: Sequence[str]) -> DataFrame:
    """For each feature, named with the time at which its value is known, how many rows have a value, how many know it
    only after the time at which it would be used, the longest delay in days, and a verdict: leak for a used feature that any
    row knows too late."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), time.cast("timestamp").alias("known")) for f, time in known.items()]))
    each = rows.select(at.cast("timestamp").alias("at"), values.alias("f")).select("at", "f.feature", "f.known")
    late = F.count_if(F.col("known") > F.col("at"))
    audit = each.groupBy("feature").agg(F.count("known").alias("n"), late.alias("late"), F.greatest(F.lit(0), F.coalesce(F.max(F.datediff("known", "at")), F.lit(0))).alias("longest_delay"))
    verdict = F.when(~F.col("feature").isin(*used), "unused").when(F.col("late") > 0, "leak").otherwise("ok")
    return audit.withColumn("verdict", verdict)


def averaging_weights(scores: DataFrame, tau: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """family, model, score, z, weight, confident for a table of models' scores (lower is better; family, model, score).

    Models are compared within their family alone: z is the distance from the median over 1.4826 times the median absolute
    distance, and weights are proportional to exp(-z / tau). A family with fewer than two valid scores is not confident and
    has no weights; a model without a score keeps its row. Scores are a report's few rows."""
    valid = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    median = valid.groupBy("family").agg(F.percentile("score", 0.5).alias("median"), F.count(F.lit(1)).alias("models"))
    apart = valid.join(median, "family").withColumn("distance", F.abs(F.col("score") - F.col("median")))
    scale = apart.groupBy("family").agg(F.percentile("distance", 0.5).alias("mad"))
    z = apart.join(scale, "family").where("models > 1").withColumn("z", (F.col("score") - F.col("median")) / (1.4826 * F.col("mad") + eps))
    low = z.groupBy("family").agg(F.min("z").alias("low"))
    grown = z.join(low, "family").withColumn("grown", F.exp(-(F.col("z") - F.col("low")) / tau))
    total = grown.groupBy("family").agg(F.sum("grown").alias("total"))
    weighed = grown.join(total, "family").select("family", "model", "z", (F.col("grown") / F.col("total")).alias("weight"))
    confident = F.coalesce(F.col("models") > 1, F.lit(False)).alias("confident")
    return scores.join(weighed, ["family", "model"], "left").join(median.select("family", "models"), "family", "left").select("family", "model", "score", "z", "weight", confident)
