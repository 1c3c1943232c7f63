"""Neighbours, hot-spot statistics and graphs over dimensions such as junctions and zones.

Dimensions are small beside the events that they are made from, and pairs are formed over grid cells or within
groups, never between all rows of a fact table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.expressions import haversine_km
from siltstone.sources.scratch import written


def nearest_neighbours(places: DataFrame, key: str, k: int, x: str = "lat", y: str = "lon", by: Sequence[str] = ()) -> DataFrame:
    """by, key, neighbour, d2, rank: the k nearest other places of the same slice by planar distance, of equal ones
    the smaller key; without `by` all places are one slice.

    Places at one point have the same distances, so that points are paired, with the k + 1 smallest keys at each: no other
    there can be among a place's k nearest. Pairs are made by a grid whose cell is wide enough for most to have k others
    within one cell's reach, so that the nearest are among the pairs; a point that is farther from the rest meets all
    points of its slice. Places without a point have no neighbours.
    """
    by = list(by)
    a = places.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(key).isNotNull()).select(*by, F.col(key), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay"))
    point = [*by, "ax", "ay"]
    first = written(a.withColumn("r", F.row_number().over(W.partitionBy(*point).orderBy(key))).where(F.col("r") <= k + 1), "points")
    counts = first.groupBy(*by).agg(F.count(F.lit(1)).alias("in_slice"))
    n = counts.agg(F.avg("in_slice")).first()[0] or 0
    span = first.agg(F.max("ax") - F.min("ax"), F.max("ay") - F.min("ay")).first()
    if n <= 1 or span[0] is None:
        return places.select(*by, F.col(key), F.col(key).alias("neighbour"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank")).limit(0)
    cell = max(span[0], span[1], 1e-9) / max(1.0, math.sqrt(n / (2.0 * (k + 1))))
    points = first.where(F.col("r") == 1).select(*point)
    b = first.select(*by, F.col(key).alias("neighbour"), F.col("ax").alias("bx"), F.col("ay").alias("by_"))
    cell_of = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*[F.struct((cell_of("ax") + i).alias("cx"), (cell_of("ay") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = points.withColumn("c", around).select(*point, "c.cx", "c.cy").join(b.withColumns({"cx": cell_of("bx"), "cy": cell_of("by_")}), [*by, "cx", "cy"])
    d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by_"), 2)
    order = W.partitionBy(*point).orderBy("d2", "neighbour")
    nearest = lambda pairs: pairs.withColumn("d2", d2).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).groupBy(*point).agg(F.array_sort(F.collect_list(F.struct("d2", "neighbour"))).alias("near"))
    # those within one cell's width are certain; where the last is farther or missing, all points are looked at
    best = nearest(near)
    best = best.join(F.broadcast(counts), by) if by else best.crossJoin(F.broadcast(counts))
    sure = written(best.where(F.size(F.filter("near", lambda p: p["d2"] <= cell * cell)) == F.least(F.lit(k + 1), F.col("in_slice"))).select(*point, "near"), "sure")
    rest = points.join(sure, point, "left_anti")
    found = sure.unionByName(nearest(rest.join(b, by) if by else rest.crossJoin(b)))
    others = F.slice(F.filter("near", lambda p: p["neighbour"] != F.col(key)), 1, k)
    each = a.join(found, point).select(*by, key, F.posexplode(others).alias("rank", "near__"))
    return each.select(*by, key, "near__.neighbour", "near__.d2", (F.col("rank") + 1).alias("rank"))


def getis_ord(places: DataFrame, neighbours: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, key and Gi* as a z score within the slice: row-standardised binary weights of the neighbours and itself."""
    by = list(by)
    weights = neighbours.select(*by, key, "neighbour").unionByName(places.select(*by, F.col(key), F.col(key).alias("neighbour")))
    values = places.select(*by, F.col(key).alias("neighbour"), F.col(value).alias("v"))
    totals = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    local = weights.join(values, [*by, "neighbour"]).groupBy(*by, key).agg(F.count(F.lit(1)).alias("m"), F.avg("v").alias("local"))
    z = (F.col("local") - F.col("mean")) / (F.col("sd") * F.sqrt((F.col("n") / F.col("m") - 1) / (F.col("n") - 1)))
    both = local.join(F.broadcast(totals), by) if by else local.crossJoin(F.broadcast(totals))
    return both.select(*by, key, F.when(F.col("sd") > 0, z).otherwise(0.0).alias("z"))


#: About how many keys of a point are listed together.
LISTED = 256


def _listed(rows: DataFrame, key: str, side: str) -> DataFrame:
    """side_lat, side_lon, side_list, side_keys: the keys at each point, in lists of about LISTED."""
    lat, lon, part, keys = (f"{side}_{c}" for c in ("lat", "lon", "list", "keys"))
    named = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("lat").alias(lat), F.col("lon").alias(lon), F.struct(F.col(key).alias("key")).alias("k"))
    lists = named.groupBy(lat, lon).agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    dealt = named.join(lists, [lat, lon]).withColumn(part, F.pmod(F.xxhash64("k.key"), F.col("lists")))
    return dealt.groupBy(lat, lon, part).agg(F.collect_list("k").alias(keys))


def within_radius(queries: DataFrame, places: DataFrame, km: float, query_key: str, key: str, digits: int | None = None) -> DataFrame:
    """query_key, key, km for all pairs within a radius, km rounded to `digits`.

    Pairs of points are found by grid cells of the radius' size and measured once, however many keys are at a point. Lists of
    keys meet by pairs of points, are dealt evenly and become pairs of keys last, so that a row of these costs no more than being
    named and no point or cell is one task's."""
    step_lat = km / 111.0
    step_lon = km / (111.0 * 0.2)  # holds up to 78 degrees of latitude
    q_lists, p_lists = written(_listed(queries, query_key, "q"), "lists"), written(_listed(places, key, "p"), "lists")
    cells = [F.struct((F.floor(F.col("q_lat") / step_lat) + i).alias("a"), (F.floor(F.col("q_lon") / step_lon) + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    q = q_lists.select("q_lat", "q_lon").distinct().withColumn("cell", F.explode(F.array(*cells)))
    p = p_lists.select("p_lat", "p_lon").distinct().withColumn("cell", F.struct(F.floor(F.col("p_lat") / step_lat).alias("a"), F.floor(F.col("p_lon") / step_lon).alias("b")))
    d = haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("p_lat"), F.col("p_lon"))
    points = q.join(p, "cell").withColumn("km", d).where(F.col("km") <= km).drop("cell")
    if digits is not None:
        points = points.withColumn("km", F.round("km", digits))
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    pairs = points.join(q_lists, ["q_lat", "q_lon"]).join(p_lists, ["p_lat", "p_lon"]).repartition(tasks, "q_lat", "q_lon", "q_list", "p_lat", "p_lon", "p_list")
    each = pairs.select("km", "p_keys", F.explode("q_keys").alias("q")).select("km", "q", F.explode("p_keys").alias("p"))
    return each.select(F.col("q.key").alias(query_key), F.col("p.key").alias(f"near_{key}"), "km")


def clique_edges(members: DataFrame, key: str, group: str) -> DataFrame:
    """a < b for keys that share a group."""
    m = members.select(F.col(key).alias("k"), F.col(group).alias("g")).where("k is not null and g is not null").distinct()
    return m.select(F.col("k").alias("a"), "g").join(m.select(F.col("k").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()


def clique_degrees(members: DataFrame, key: str, group: str) -> DataFrame:
    """a, degree, last: of each key that has any, how many greater keys share a group with it, and the greatest of them, as
    clique_edges' pairs would tell. Within a group this is a place in its order; pairs are formed among the keys of
    several groups alone, where a pair that shares more than one would count more than once."""
    m = written(members.select(F.col(key).alias("k"), F.col(group).alias("g")).where("k is not null and g is not null").distinct(), "members")
    # ranges of group and key, so that no group is one task's
    ranged = written(m.repartitionByRange("g", "k").withColumn("part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"))
    later = ends.withColumn("later", F.coalesce(F.sum("rows").over(W.partitionBy("g").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    placed = ranged.withColumn("after", F.row_number().over(W.partitionBy("g", "part").orderBy(F.desc("k"))) - 1).join(later, ["g", "part"])
    tops = m.groupBy("g").agg(F.max("k").alias("top"))
    each = placed.join(tops, "g").groupBy("k").agg(F.sum(F.col("after") + F.col("later")).alias("degree"), F.max("top").alias("last"))
    several = m.join(m.groupBy("k").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1"), "k").select("k", "g")
    twice = several.select(F.col("k").alias("a"), "g").join(several.select(F.col("k").alias("b"), "g"), "g").where("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0").groupBy(F.col("a").alias("k")).agg(F.sum("more").alias("more"))
    degree = (F.col("degree") - F.coalesce("more", F.lit(0))).cast("long")
    return each.join(twice, "k", "left").where("degree > 0").select(F.col("k").alias("a"), degree.alias("degree"), "last")


def chain_edges(members: DataFrame, key: str, group: str, order: Sequence[Column]) -> DataFrame:
    """a -> b for neighbours in a group's order, both ways."""
    linked = members.withColumn("b", F.lead(key).over(W.partitionBy(group).orderBy(*order, key))).where("b is not null").select(F.col(key).alias("a"), "b")
    return linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hops(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """source, node, hops: shortest numbers of steps along a -> b, up to `most`."""
    edges = written(edges.select("a", "b").distinct(), "edges")
    reached = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    front = reached
    for step in range(1, most + 1):
        ahead = front.join(edges, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        front = written(ahead.join(reached.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(step)), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def cheapest_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """source, blocked, node, cost: the cheapest way along edges a -> b with a positive weight, up to the cutoff.

    Each round goes on from the costs that fell in the last one alone, and the rounds end when none falls. A source's
    own node may be left out of its ways by leaving it out of the edges' ends (blocked is its name)."""
    edges = written(edges.select("a", "b", "weight"), "edges")
    best = sources.select("source", "blocked", "node", F.lit(0.0).alias("cost"), F.lit(True).alias("fell"))
    while True:
        step = best.where("fell").join(edges, F.col("node") == F.col("a")).where(~F.col("b").eqNullSafe(F.col("blocked")))
        step = step.select("source", "blocked", F.col("b").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.lit(True).alias("new")).where(F.col("cost") <= cutoff)
        known = best.select("source", "blocked", "node", "cost", F.lit(False).alias("new"))
        both = known.unionByName(step).groupBy("source", "blocked", "node").agg(F.min("cost").alias("cost"), F.min(F.when(~F.col("new"), F.col("cost"))).alias("before"))
        best = written(both.select("source", "blocked", "node", "cost", (F.col("before").isNull() | (F.col("cost") < F.col("before"))).alias("fell")), "costs")
        if best.where("fell").isEmpty():
            return best.drop("fell")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """node, rank: power iteration over weighted edges; nodes without out-edges share with all."""
    edges = written(edges.select("a", "b", "weight"), "edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    n = nodes.count()
    out = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    shares = written(edges.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")), "shares")
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    ends = written(nodes.join(out.select(F.col("a").alias("node")), "node", "left_anti"), "ends")
    for i in range(rounds):
        loose = rank.join(ends, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        came = shares.join(rank, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        rank = nodes.join(came, "node", "left").crossJoin(F.broadcast(loose)).select("node", ((1 - damping) / n + damping * (F.coalesce("came", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if i % 4 == 3:  # the plan of a few rounds is small; longer ones are cut
            rank = written(rank, "rank")
    return rank


def betweenness(edges: DataFrame, block: int = 1000, most: int = 1_000) -> DataFrame:
    """node, betweenness: for each node the sum over pairs of other nodes of the share of their shortest ways, in steps
    along a -> b, that lead through it, over the number of such ordered pairs.

    Outwards, rounds of joins count the ways by source and distance; back, each distance hands what leads through it to the
    one before. Sources are taken in blocks, so that what is written at once is bounded by block times nodes."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    n = nodes.count()
    blocks = max(1, -(-n // block))
    parts = nodes.select("node", F.lit(0.0).alias("part"))
    for k in range(blocks):
        front = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select(F.col("node").alias("source"), "node", F.lit(1.0).alias("ways"))
        levels, reached = [written(front, "ways")], front.select("source", "node")
        for _ in range(most):
            ahead = levels[-1].join(edges, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("ways").alias("ways"))
            level = written(ahead.join(reached, ["source", "node"], "left_anti"), "ways")
            if level.isEmpty():
                break
            levels.append(level)
            reached = reached.unionByName(level.select("source", "node"))
        through = levels[-1].withColumn("through", F.lit(0.0))
        for level in reversed(levels[:-1]):
            later = through.select("source", F.col("node").alias("b"), ((1 + F.col("through")) / F.col("ways")).alias("gain"))
            handed = level.join(edges, F.col("node") == F.col("a")).join(later, ["source", "b"]).groupBy("source", "node").agg(F.sum(F.col("ways") * F.col("gain")).alias("through"))
            through = written(level.join(handed, ["source", "node"], "left").na.fill(0.0, ["through"]), "through")
            parts = parts.unionByName(through.where("source <> node").select("node", F.col("through").alias("part")))
    return parts.groupBy("node").agg((F.sum("part") / max(1, (n - 1) * (n - 2))).alias("betweenness"))


def eigenvector(edges: DataFrame, rounds: int = 8, steps: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """node, eigenvector: the leading eigenvector of the weighted edges a -> b over what comes in, of length 1. A step adds
    a node's own value, so that alternating graphs settle too; a round of a few steps is scaled and written, and rounds
    end when values have settled."""
    edges = written(edges.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    value = nodes.withColumn("x", F.lit(1.0 / max(1, nodes.count()) ** 0.5))
    for _ in range(rounds):
        new = value.withColumn("y", F.col("x"))
        for _ in range(steps):
            came = edges.join(new, F.col("a") == F.col("node")).groupBy(F.col("b").alias("to")).agg(F.sum(F.col("weight") * F.col("y")).alias("came"))
            new = new.join(came, F.col("node") == F.col("to"), "left").select("node", "x", (F.col("y") + F.coalesce("came", F.lit(0.0))).alias("y"))
        new = written(new, "eigen")
        norm = new.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        moved = new.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0] or 0.0
        value = new.select("node", (F.col("y") / norm).alias("x"))
        if moved < tolerance:
            break
    return value.withColumnRenamed("x", "eigenvector")
