"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are uniform, so equal ranges of the key cut each source into
even buckets; documents are sorted within (source, bucket), and prefix sums of bucket totals turn the sums
within a bucket into prefix sums over the whole source, whose largest bucket, not the source, is what one
task sorts. Each source is cut at its exact budget, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

#: Rows of a source that share a bucket, about; and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256
#: Equal rows that one task writes out at once, at most.
EQUAL_ROWS = 100_000


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets by weight, none above cap times its source's size, the excess reshared among the others.

    sources has one row per source and is small beside the documents. Sorted by cap / weight, the sources that
    reach their cap come first; the level at which the others share the rest follows from running sums.
    """
    by_name, everything = W.orderBy("no_source", "source_key"), W.partitionBy()
    by_ratio = W.orderBy("ratio", "place")
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("before", F.sum("most").over(by_ratio) - F.col("most"))
        .withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("most", F.col("weight") * F.col("level")), "most"))
        .select("source_key", "no_source", "source_size", "target")
    )


def take(size: Column, prefix: Column, budget: Column, total: Column) -> Column:
    """Words taken of a document: whole epochs, then what the rest of the budget leaves after earlier documents."""
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(F.lit(0))
    rest = budget - epochs * total
    return epochs * size + F.greatest(F.lit(0), F.least(size, rest - (prefix - size)))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Sources by code point, null last, take the weights in turn. The sum of a source's taken words is its target
    rounded down; the document at the cut is taken in part, and no document more than cap times. Null and empty
    texts have size 0 and are taken 0 times. Equal keys (repeated or null ids) are ordered by size; rows of one
    source, id and size cannot be told apart, so they are counted before they are sorted, whatever their number, and
    written out again afterwards. The order depends on doc_id, size and seed alone, so reruns agree. Very long texts
    count whole; empty tables give empty results; other columns are not read.
    """
    columns = {
        "doc_id": F.col(id_col),
        "source_key": F.coalesce(F.col(source_col), F.lit("")),
        "no_source": F.col(source_col).isNull(),
        "size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
        "key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))),
    }
    rows = materialize(docs.select([c.alias(name) for name, c in columns.items()]), "sizes")
    buckets = max(LEAST_BUCKETS, rows.count() // bucket_rows)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    source, bucket = ["source_key", "no_source"], ["source_key", "no_source", "bucket"]
    totals = materialize(rows.groupBy(bucket).agg(F.sum("size").alias("bucket_size")), "buckets")
    targets = _targets(totals.groupBy(source).agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    earlier = totals.withColumn("earlier", F.sum("bucket_size").over(W.partitionBy(source).orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    plan = earlier.join(targets, source)
    equal = rows.groupBy(*bucket, "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    within = W.partitionBy(bucket).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    size, n = F.col("size"), F.col("n")
    placed = equal.withColumn("before", F.sum(size * n).over(within) - size * n).join(plan, bucket)
    placed = placed.select("doc_id", "size", "source_size", "target", (F.col("before") + F.col("earlier")).alias("before"), "n")
    every = lambda last: F.explode(F.sequence(F.lit(0), last))
    few, many = placed.where(n <= equal_rows), placed.where(n > equal_rows)
    parts = many.withColumn("part", every(F.floor((n - 1) / equal_rows))).repartition("doc_id", "size", "part")
    parts = parts.select("doc_id", "size", "source_size", "target", (F.col("before") + F.col("part") * equal_rows * size).alias("before"), F.least(F.lit(equal_rows).cast("long"), n - F.col("part") * equal_rows).alias("n"))
    single = few.unionByName(parts).withColumn("i", every(n - 1))
    prefix = F.col("before") + (F.col("i") + 1) * size
    return single.select("doc_id", "size", "source_size", "target", take(size, prefix, F.floor("target"), F.col("source_size")).cast("long").alias("taken"))
