"""Joins, aggregates and windows that several domains share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.scratch import written


def category_codes(df: DataFrame, column: str, missing: str = "__MISSING__") -> DataFrame:
    """Distinct values with codes from 0 in alphabetical order; null is a value of its own. A window over the
    distinct values alone is not partitioned; a dimension has few of them."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).distinct()
    return values.withColumn(f"{column}_code", F.row_number().over(W.orderBy(column)) - 1)


def top_n_or_other(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """df with the column's values outside its n most frequent ones (ties by value) collapsed."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("top_n")).orderBy(F.desc("top_n"), column).limit(n).select(F.col(column).alias("top_value"))
    joined = df.join(F.broadcast(top), F.col(column) == F.col("top_value"), "left")
    return joined.withColumn(column, F.coalesce("top_value", F.lit(other))).drop("top_value")


def rank_percent(value: Column, by: Sequence[str] = ()) -> Column:
    """Average rank divided by the number of rows."""
    part = W.partitionBy(*by)
    ordered, peers = part.orderBy(value), W.partitionBy(*by, value)
    return (F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2) / F.count(F.lit(1)).over(part)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n, below, part: each distinct value, its rows, the rows with smaller values, and its range's number.

    Values are counted first and dealt by ranges; sums over the ranges, of which there are as many as tasks, turn
    the sums within a range into sums over everything, so that no task sees more than its range. Null values go.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranges")
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0))).drop("rows")
    within = W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(parts), "part").select(value, "n", (F.col("before") + F.col("within")).alias("below"), "part")


def exact_quantiles(df: DataFrame, value: str, steps: int) -> list[float]:
    """The values at 0, 1/steps, 2/steps, ... of the way through the sorted rows, between two rows in proportion; none
    without rows. Each range of values finds the places that lie in it; steps + 1 numbers reach the driver."""
    ranks = value_ranks(df, value)
    rows = ranks.agg(F.sum("n")).first()[0]
    if not rows:
        return []
    places = [divmod((rows - 1) * i, steps) for i in range(steps + 1)]
    wanted = sorted({at for at, _ in places} | {min(at + 1, rows - 1) for at, _ in places})
    asked = df.sparkSession.createDataFrame([(at,) for at in wanted], "at long")
    hits = ranks.join(F.broadcast(asked), (F.col("at") >= F.col("below")) & (F.col("at") < F.col("below") + F.col("n")))
    found = {r["at"]: float(r[value]) for r in hits.select("at", value).collect()}
    return [found[at] + (found[min(at + 1, rows - 1)] - found[at]) * (rest / steps) for at, rest in places]


def running_sums(df: DataFrame, order: str, columns: Sequence[str], *, descending: bool = False, part: str | None = None) -> DataFrame:
    """df, one row for each value of order, with the columns summed over that row and all before it.

    Rows are dealt by ranges; sums over the ranges, of which there are as many as tasks, turn the sums within a range into
    sums over everything, so that no task sees more than its range. A written table that is dealt already names the column
    that numbers its ranges upwards."""
    if part is None:
        df = written(df.repartitionByRange(order).withColumn("part__", F.spark_partition_id()), "running")
    by = part or "part__"
    turned = F.desc if descending else F.asc
    before = W.orderBy(turned(by)).rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(by).agg(*[F.sum(c).alias(c) for c in columns]).select(by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}__before") for c in columns])
    within = W.partitionBy(by).orderBy(turned(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumns({c: F.sum(c).over(within) for c in columns}).join(F.broadcast(parts), by)
    return summed.select(*[(F.col(c) + F.col(f"{c}__before")).alias(c) if c in columns else F.col(c) for c in df.columns if c != "part__"])


def fallback_lookup(levels: Sequence[tuple[str, DataFrame, Sequence[str]]], queries: DataFrame, values: Sequence[str], constants: Mapping[str, float], support: str = "n", least: int = 5) -> DataFrame:
    """queries with values from the first level that has enough support, and that level's name.

    A level is a name, a table of keys, support and values, and its keys; no keys means one row for everything.
    Where no level is supported the constants hold. Level tables are dimensions: at most a row for each key.
    """
    out = queries
    for i, (_, stats, keys) in enumerate(levels):
        side = stats.select(*keys, *[F.col(v).alias(f"{v}__{i}") for v in (*values, support)])
        out = out.join(side, list(keys), "left") if keys else out.crossJoin(F.broadcast(side))
    enough = [F.coalesce(F.col(f"{support}__{i}") >= least, F.lit(False)) for i in range(len(levels))]
    for v in values:
        pick = F.lit(constants[v])
        for i in reversed(range(len(levels))):
            pick = F.when(enough[i], F.col(f"{v}__{i}")).otherwise(pick)
        out = out.withColumn(v, pick)
    label, held = F.lit("constant"), F.lit(0)
    for i in reversed(range(len(levels))):
        label = F.when(enough[i], levels[i][0]).otherwise(label)
        held = F.when(enough[i], F.col(f"{support}__{i}")).otherwise(held)
    out = out.withColumn("level", label).withColumn("support", held.cast("long"))
    return out.drop(*[f"{v}__{i}" for i in range(len(levels)) for v in (*values, support)])


def top_k_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def quantile_bins(value: Column, edges: Column) -> Column:
    """The number, from 1, of the right-closed bin between quantile edges that holds a value; the lowest edge belongs to bin 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.array_distinct(edges), lambda e: e < value)))


def grouped_report(df: DataFrame, groups: Mapping[str, Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """One report over several groupings: group_type, group_value and the aggregates.

    Each row is tagged with every grouping in one pass and aggregated once."""
    tags = [F.struct(F.lit(name).alias("group_type"), (F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]) if cols else F.lit("all")).alias("group_value")) for name, cols in groups.items()]
    tagged = df.withColumn("tag", F.explode(F.array(*tags)))
    return tagged.groupBy(F.col("tag.group_type").alias("group_type"), F.col("tag.group_value").alias("group_value")).agg(*aggregates)


def entropy_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column name and weight: one minus the normalised entropy of each column's shares, over their sum."""
    totals = df.agg(F.count(F.lit(1)).alias("n__rows"), *[F.sum(c).alias(f"{c}__total") for c in columns])
    shares = df.select(*columns).crossJoin(F.broadcast(totals))
    p = [F.col(c) / F.col(f"{c}__total") for c in columns]
    sums = shares.agg(F.first("n__rows").alias("n__rows"), *[F.sum(F.when(x > 0, -x * F.log(x)).otherwise(0.0)).alias(c) for x, c in zip(p, columns, strict=True)])
    spread = [1 - F.col(c) / F.log("n__rows") for c in columns]
    total = sum(spread[1:], spread[0])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), (s / total).alias("weight")) for s, c in zip(spread, columns, strict=True)])).alias("w")).select("w.component", "w.weight")


def min_max(column: str, constant: float, by: Sequence[str] = ()) -> Column:
    """A column scaled to 0 to 1; `constant` where all its values are equal."""
    part = W.partitionBy(*by)
    low, high = F.min(column).over(part), F.max(column).over(part)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(constant)
