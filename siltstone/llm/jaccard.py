"""N-gram Jaccard join with several global token orders.

In any order of all tokens, two sets whose similarity reaches the threshold t share a token within their first
n - ceil(t n) + 1 tokens; within their first n - ceil(t n) + k they share k. Three orders are used, none of
which needs to be exact for the result to be:

A. by hash. Half as long again as the plain prefix, so that a set needs many tokens in common with any other
   sets at all: as many as the prefixes of both share at least, whatever size a linked set has. Most documents
   end here, after one shuffle of about a fifth of their tokens.
B. by the number of remaining sets that hold a token, rare ones first, then by hash. Shared passages come last
   in it. Its prefixes make the buckets in which pairs are sought.
C. as B with another hash.

A pair must share prefix tokens in B, in C and in A before its sets are compared. Within a bucket all sets are
first compared with one leader, which differs from bucket to bucket; sets that are linked already need no
comparison, so a large group of near copies costs one comparison for each copy and bucket, not one for each
pair. What is still apart after a few leaders is compared pair by pair, without any cap. A pair leaves its
bucket's join only if bounds on its sets allow a link: their sizes, the tokens that no other set holds, and
the parity bits of their tokens, as the symmetric difference has at least as many tokens as bits that differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialize, text_of
from .components import connected_components

STAR_ROUNDS = 2
#: 64-bit words of parity bits of a set; more of them bound larger sets more tightly.
PARITY_WORDS = 16


def _least_shared(n: Column, percent: int) -> Column:
    """Tokens that a set of n shares at least with any set it links with: ceil(percent * n / 100)."""
    return F.floor((n * percent + 99) / F.lit(100)).cast("int")


def _prefix(n: Column, percent: int) -> Column:
    return (n - _least_shared(n, percent) + 1).cast("int")


def _posted(n, percent: int):
    """Tokens that a set of n posts in order A; n is a number or an array."""
    first = n + 1 - -(-percent * n // 100)
    return np.minimum(n, first + first // 2)


@lru_cache(maxsize=1 << 16)
def _needed(n: int, percent: int) -> int:
    """Tokens that the prefixes in order A of a set of n and of any set it links with share at least.

    Sets of n and m that link have `common` tokens or more; the k-th of these is at place k + n - common at most
    in the one and k + m - common in the other. What a smaller partner posts counts as well as the own prefix."""
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    common = -(-percent * (n + m) // (100 + percent))
    shared = np.minimum(common, np.minimum(_posted(n, percent) - (n - common), _posted(m, percent) - (m - common)))
    return int(shared[common <= np.minimum(n, m)].min())


def _signatures(width: int, percent: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, ones, twos, prefixes, plain, needs = [], [], [], [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), width):
                    n = len(tokens)
                    first = n - -(-percent * n // 100) + 1 if n else 0
                    one, two = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
                    sizes.append(n)
                    ones.append(one)
                    twos.append(two)
                    plain.append(first)
                    needs.append(_needed(n, percent))
                    prefixes.append(tokens[: _posted(n, percent)].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(plain, pa.int32()), pa.array(needs, pa.int32()), tokens],
                    names=["doc_id", "n", "one", "two", "plain", "need", "prefix"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _full_sets(width: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(1).to_pylist(), width))
                bits = [np.packbits((np.bincount((s % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1).astype(bool)).view(np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.concatenate(bits))),
                    ],
                    names=["node", "tokens", "bits"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _may_link(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether the bounds of two sets (n, held, bits) allow 100 * intersection >= percent * union."""
    total = a("n") + b("n")
    # links share at least percent / (100 + percent) of both sizes together, and differ in the rest
    common = F.floor((total * percent + 99 + percent) / F.lit(100 + percent))
    differ = sum((F.bit_count(a("bits")[k].bitwiseXOR(b("bits")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    return (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * percent) & (F.least(a("held"), b("held")) >= common) & (differ <= total - 2 * common)


def shingle_signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, a 128-bit signature of the set (one, two), the plain length of its prefix in order A, the tokens
    it needs to share there, and the prefix with half as much again."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n", "one", "two")] + [T.StructField(c, T.IntegerType()) for c in ("plain", "need")] + [T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(_signatures(width, percent), schema)


def _in_order_a(sets: DataFrame) -> DataFrame:
    """The nodes whose prefix in order A shares as many tokens with other sets as a link needs."""
    posted = sets.select("node", F.explode("prefix").alias("token"))
    shared = posted.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    counts = posted.join(shared, "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    return sets.join(counts, "node").where(F.col("shared") >= F.col("need")).select("node")


def _in_orders_b_c(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, held, prefix_b, prefix_c: the number of tokens that other sets hold too, and the prefixes' of that kind, for nodes that have any.
    Tokens that one set alone holds come first in these orders and only take up places."""
    posted = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    held = posted.join(counts, "token")

    # a node's list is as long as its own text
    lists = held.groupBy("node", "n").agg(F.count(F.lit(1)).alias("held"), F.collect_list(F.struct("sets", "token")).alias("tokens"))
    places = _prefix(F.col("n"), percent) - (F.col("n") - F.col("held")).cast("int")

    def first(name: str) -> Column:
        keyed = F.transform("tokens", lambda t: F.struct(t["sets"].alias("sets"), F.xxhash64(t["token"], F.lit(name)).alias("h"), t["token"].alias("token")))
        return F.transform(F.slice(F.array_sort(keyed), 1, F.col("places")), lambda t: t["token"])

    return lists.withColumn("places", places).where("places > 0").select("node", "n", "held", first("b").alias("prefix_b"), first("c").alias("prefix_c"))


def _linked(pairs: DataFrame, filters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the filters of every order and whose sets then prove similar."""

    def side(name: str) -> DataFrame:
        return filters.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("prefix_a", "prefix_b", "prefix_c")])

    passed = pairs.join(side("a"), "a").join(side("b"), "b")
    for order in ("b", "c", "a"):
        passed = passed.where(F.arrays_overlap(f"prefix_{order}_a", f"prefix_{order}_b"))
    survivors = materialize(passed.select("a", "b"), "survivors")
    a, b = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in ("a", "b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return survivors.join(a, "a").join(b, "b").where(common * 100 >= (F.size("tokens_a") + F.size("tokens_b") - common) * percent).select("a", "b")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similar_components(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A text's set are its distinct shingles of `width` words (shingles.py); of fewer words, all of them as one.
    Texts link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable, a
    text's own where nothing links. Null, empty and blank texts have no shingles and link with nothing.
    Equal sets are one node, however many rows have them. Rows that share a doc_id are one node as well and
    should have one text; a null doc_id gets the component of equal texts with ids, else null, and is not a
    node itself. Other columns are not read. Shingles are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    sets = materialize(shingle_signatures(rows, width, percent), "signatures")
    key = ["n", "one", "two"]
    groups = materialize(sets.where("n > 0").groupBy(key).agg(F.min("doc_id").alias("node")), "groups")
    nodes = sets.join(groups.where("node is not null").select(*key, F.col("node").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id", *key]).withColumnRenamed("doc_id", "node")
    nodes = materialize(nodes.select("node", "n", "plain", "need", "prefix"), "nodes")

    left = bounded(materialize(_in_order_a(nodes), "order_a"))
    texts = rows.withColumnRenamed("doc_id", "node").join(left, "node", "left_semi").dropDuplicates(["node", "text"])
    schema = T.StructType([T.StructField("node", texts.schema["node"].dataType)] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("tokens", "bits")])
    full = materialize(texts.mapInArrow(_full_sets(width), schema), "sets")
    in_b_c = _in_orders_b_c(full, percent)
    filters = materialize(in_b_c.join(nodes.select("node", F.slice("prefix", 1, F.col("plain")).alias("prefix_a")), "node"), "filters")
    posted = materialize(filters.select("node", F.explode("prefix_b").alias("token")).distinct(), "buckets")
    live = materialize(full.join(bounded(filters.select("node")), "node", "left_semi"), "live_sets")
    bounds = materialize(filters.select("node", "n", "held").join(live.select("node", "bits"), "node"), "bounds")

    links = None
    components = None
    seen = None
    for step in range(star_rounds + 1):
        if components is None:
            placed = posted.withColumn("component", F.col("node"))
        else:
            placed = posted.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        placed = materialize(placed.join(apart, "token", "left_semi"), f"apart{step}")
        if placed.isEmpty():
            break
        x, y = (placed.join(bounds, "node").alias(side) for side in ("x", "y"))
        if step < star_rounds:
            leader = placed.groupBy("token").agg(F.min_by("node", F.xxhash64("node", "token", F.lit(step))).alias("node"))
            y = placed.join(leader, ["token", "node"]).join(bounds, "node").alias("y")
            apart = F.col("x.component") != F.col("y.component")
        else:
            apart = F.col("x.component") < F.col("y.component")
        near = _may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & near).select(*_pair(F.col("x.node"), F.col("y.node")))
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs{step}")
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = materialize(_linked(pairs, filters, live, percent), f"links{step}")
        links = found if links is None else links.unionByName(found)
        components = materialize(connected_components(links), f"components{step}")

    if components is not None:
        groups = groups.join(components, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    placed = sets.select("doc_id", *key).join(groups, key, "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("node", "doc_id").alias("component_id"))
