"""Reading and writing tables: strict, tolerant and projected scans, sinks, export views and a dataset registry."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The logical contract of a raw incident log.
RAW_INCIDENT = T.StructType(
    [T.StructField("event_id", T.StringType())]
    + [T.StructField(c, T.TimestampType()) for c in ("start_datetime", "end_datetime", "modified_datetime", "created_date", "closed_datetime", "resolved_datetime")]
    + [T.StructField(c, T.StringType()) for c in ("event_cause", "event_type", "status", "corridor", "zone", "junction", "police_station", "veh_type", "priority", "requires_road_closure")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV file with a header under a schema: columns by name, an old name read where the new one is missing,
    unparseable values and missing columns as null."""
    raw = spark.read.csv(path, header=True)
    for old, new in (renames or {}).items():
        if old in raw.columns and new not in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    return raw.select([(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """The table, or an empty one of the schema where there is none at the path."""
    try:
        return spark.read.format(format).option("header", True).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_available(spark: SparkSession, paths: Sequence[str], schema: T.StructType, format: str = "parquet") -> DataFrame:
    """The first of several tables that has any rows."""
    found = spark.createDataFrame([], schema)
    for path in paths:
        found = read_or_empty(spark, path, schema, format)
        if not found.isEmpty():
            break
    return found


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """df with a default column for each name it lacks; a Column default may be an expression."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def export_view(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns of the list that exist, in its order; all without a list."""
    return df.select([c for c in columns if c in df.columns]) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(summary: DataFrame, path: str, title: str) -> None:
    """A report: the title, then a line of names and values for each row of a summary."""
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in summary.columns])
    lines = summary.sparkSession.createDataFrame([(title,)], "value string").unionByName(summary.select(pairs.alias("value")))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_parameters(spark: SparkSession, path: str, parameters: Mapping[str, object]) -> None:
    """Fitted parameters as a table of names and JSON values."""
    spark.createDataFrame([(k, json.dumps(v)) for k, v in parameters.items()], "name string, value string").write.mode("overwrite").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> dict[str, object]:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}


def enrich(target: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """target with extra's columns, replacing those of an earlier enrichment; doing it twice changes nothing."""
    new = [c for c in extra.columns if c not in on]
    return target.drop(*new).join(extra.dropDuplicates(list(on)), list(on), "left")


@dataclass(frozen=True)
class Dataset:
    """A table that may be served: its name, columns, default order and page size."""

    table: str
    columns: tuple[str, ...]
    sort: str
    descending: bool = False
    page_size: int = 25


def page(df: DataFrame, spec: Dataset, *, text: str = "", sort: str | None = None, descending: bool | None = None, page: int = 1, page_size: int | None = None) -> DataFrame:
    """One page: rows whose visible columns contain the text, numbers before other texts, ties by all columns."""
    shown = export_view(df, spec.columns)
    if text:
        shown = shown.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in shown.columns])), F.lit(text.lower())))
    key = F.col(sort or spec.sort).cast("string")
    down = spec.descending if descending is None else descending
    number = key.try_cast("double")
    order = [number.desc_nulls_last() if down else number.asc_nulls_last(), key.desc_nulls_last() if down else key.asc_nulls_last(), *shown.columns]
    size = max(1, min(200, page_size or spec.page_size))
    return shown.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
