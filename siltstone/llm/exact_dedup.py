"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries summary (Spark's approx_top_k keeps one per task and merges them) names the digests that may be
frequent. Their winners are computed exactly with map-side partial aggregation, and the few rows of winners
are broadcast, so that frequent groups are settled where their rows are. All other digests are shuffled; by
the summary's guarantee none of those groups holds more than about 1 / HEAVY of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_of

#: Counters of the summary, and the most digests taken from it. The summary's error is 1 / HEAVY of all rows, so a
#: digest that holds more is always taken; the broadcast never exceeds HEAVY rows of about 100 bytes.
COUNTERS, HEAVY = 16_384, 12_288


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is deleted; null counts as empty, so null, empty
    and blank texts are one group. The row with the most code points in the original text stays, then the one
    with the smallest doc_id (null last). Of repeated rows with the same id exactly one is kept. Very long
    texts are hashed whole. Empty tables give empty results; other columns are not read.
    """
    text = text_of(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).alias("points"),
            F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # the winner is the minimum of this order
    order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    found = rows.select(F.hex("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {heavy}, {counters})").alias("top"))
    frequent = found.select(F.explode("top").alias("t")).where(F.col("t.count") > 1).select(F.unhex("t.item").alias("digest"))
    frequent = materialize(frequent.limit(heavy), "frequent")
    winners = rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("winner"))
    settled = rows.join(F.broadcast(winners), "digest")
    group = W.partitionBy("digest")
    others = rows.join(F.broadcast(frequent), "digest", "left_anti").withColumns({"group_size": F.count(F.lit(1)).over(group), "winner": F.min(order).over(group)})
    columns = [
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return settled.select(columns).unionByName(others.select(columns))
