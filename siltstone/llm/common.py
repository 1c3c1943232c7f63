"""Shared helpers: tables read by path, written intermediate tables, sides that may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder all executors share and read it back: cuts lineage, survives lost executors, and
    fixes what is not deterministic under recomputation (row ids, partition ids)."""
    return written(df, name)


def text_of(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def bounded(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """keys, a written table of few narrow columns, as a side to broadcast if it has at most `most` rows;
    beyond that it is joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys
