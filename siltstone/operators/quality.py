"""Data quality: robust outlier scores with fallback, trust profiles, quarantine with reasons, scalers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import reasons


def modified_z(df: DataFrame, value: str, levels: Sequence[Sequence[str]], least: int = 10) -> DataFrame:
    """df with modified_z = 0.6745 (x - median) / MAD and z_level, the number of the level that gave them.

    Each level's keys need `least` valid rows (value not negative) and a MAD above 0, else the next level is used;
    the last one should have no keys. Null keys are groups of their own.
    """
    valid = df.where(F.col(value) >= 0)
    out = df
    for i, keys in enumerate(levels):
        null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("__null__")).alias(f"k{i}_{j}") for j, k in enumerate(keys)]
        names = [f"k{i}_{j}" for j in range(len(keys))]
        base = valid.select(*null_safe, F.col(value).alias("x"))
        middle = base.groupBy(*names).agg(F.percentile("x", F.lit(0.5)).alias(f"m{i}"), F.count(F.lit(1)).alias(f"n{i}"))
        joined = base.join(middle, names) if names else base.crossJoin(F.broadcast(middle))
        mad = joined.groupBy(*names).agg(F.percentile(F.abs(F.col("x") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}"), F.first(f"m{i}").alias(f"m{i}"), F.first(f"n{i}").alias(f"n{i}"))
        out = out.select("*", *null_safe)
        out = (out.join(mad, names, "left") if names else out.crossJoin(F.broadcast(mad))).drop(*names)
    score, level = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i in reversed(range(len(levels))):
        usable = (F.col(f"n{i}") >= (least if levels[i] else 1)) & (F.col(f"d{i}") > 0)
        score = F.when(usable, 0.6745 * (F.col(value) - F.col(f"m{i}")) / F.col(f"d{i}")).otherwise(score)
        level = F.when(usable, i).otherwise(level)
    out = out.withColumn("modified_z", F.when(F.col(value) >= 0, score)).withColumn("z_level", F.when(F.col(value) >= 0, level))
    return out.drop(*[f"{c}{i}" for i in range(len(levels)) for c in "mdn"])


def quarantine(df: DataFrame, rules: Mapping[str, Column], value: str) -> DataFrame:
    """df with quarantine_reasons (all that hold, joined by |, else null) and the value nulled where there is one."""
    out = df.withColumn("quarantine_reasons", reasons(rules))
    return out.withColumn(value, F.when(F.col("quarantine_reasons").isNull(), F.col(value)))


def quarantine_summary(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """reason and rows for every rule, those without rows included."""
    spark = df.sparkSession
    found = df.select(F.explode(F.split("quarantine_reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(r,) for r in rules], "reason string")
    return names.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("rows"))


def robust_scale(df: DataFrame, columns: Sequence[str], train: Column, factor: float = 1.4826) -> DataFrame:
    """Columns centred by the train rows' median and divided by their MAD, their deviation or 1."""
    rows = df.where(train)
    middle = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"{c}__m") for c in columns])
    spread = rows.crossJoin(F.broadcast(middle)).agg(*[F.percentile(F.abs(F.col(c) - F.col(f"{c}__m")), F.lit(0.5)).alias(f"{c}__d") for c in columns], *[F.stddev_samp(c).alias(f"{c}__s") for c in columns])
    out = df.crossJoin(F.broadcast(middle.crossJoin(spread)))
    scale = {c: F.when(F.col(f"{c}__d") >= 1e-6, F.col(f"{c}__d") * factor).when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0) for c in columns}
    out = out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"{c}__m")) / scale[c] for c in columns})
    return out.drop(*[f"{c}__{x}" for c in columns for x in "mds"])
