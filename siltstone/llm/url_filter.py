"""URL filters: a Bloom filter cascade decides membership in a list exactly, without joining the corpus.

The universe is every key by which the corpus's URLs can match the list: first their hosts' suffixes, then for listed hosts
the lengths of that host's rules, then the paths' prefixes of these lengths. Level 0 encodes the listed keys; level 1 encodes the keys of the universe that level 0 takes wrongly; level 2 the listed keys that
level 1 takes wrongly; and so on until no error is left. A key of the universe is listed exactly if the first
level that refuses it has an odd number, or, where no level refuses it, if the number of levels is odd. The
cascade's size follows the list, not the corpus: level 0's error rate is chosen from both counts so that each
later level holds at most about as many keys as the list has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: A broadcast filter may have so many bits at most (128 MB); a longer list is split by hashes into cascades of its parts.
MOST_BITS = 1 << 30
#: Bits of a word, and words of a filter that come to the driver in one row.
WORD_BITS, CHUNK_WORDS = 32, 1024


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for k in range(self.hashes):
            place = (first + np.uint64(k) * second) % np.uint64(self.bits)
            found &= (self.words[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return found


@dataclass
class Cascade:
    """levels[k] was built with the hash seeds of level k."""

    levels: list[Level] = field(default_factory=list)

    def listed(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether keys are listed, from their two hashes at each level."""
        n = len(hashes[0][0]) if hashes else 0
        answer = np.full(n, len(self.levels) % 2 == 1)
        open_ = np.ones(n, bool)
        for k, level in enumerate(self.levels):
            refused = open_ & ~level.has(*hashes[k])
            answer[refused] = k % 2 == 1
            open_ &= ~refused
        return answer

    def listed_digests(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether keys are listed, from their two digests."""
        return self.listed([level_hashes(one, two, k) for k in range(len(self.levels))]) if self.levels else np.zeros(len(one), bool)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def level_hashes(one: np.ndarray, two: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of a key at a level, from its two 64-bit digests."""
    return _mix(one, 2 * level + 1) >> np.uint64(1), (_mix(two, 2 * level + 2) >> np.uint64(1)) | np.uint64(1)


def digests(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit("second")).alias("two")]


def _bits_of(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """The filter's words; set in tasks, merged by bit_or, so that what returns is bounded by the filter's size."""

    def positions(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            one, two = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
            first, second = level_hashes(one, two, level)
            place = np.unique(np.concatenate([(first + np.uint64(k) * second) % np.uint64(bits) for k in range(hashes)])).astype(np.int64)
            word, start = np.unique(place >> 5, return_index=True)
            value = np.bitwise_or.reduceat(np.int64(1) << (place & 31), start) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value, pa.int64())], names=["word", "value"])

    def chunk(key, table):
        import pyarrow as pa

        part = np.zeros(CHUNK_WORDS, np.uint32)
        part[table.column("word").to_numpy() % CHUNK_WORDS] = table.column("value").to_numpy()
        return pa.table({"chunk": [key[0].as_py()], "words": [part.tobytes()]})

    found = keys.mapInArrow(positions, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    words = np.zeros(-(-bits // WORD_BITS // CHUNK_WORDS) * CHUNK_WORDS, np.uint32)
    for row in found.withColumn("chunk", F.floor(F.col("word") / CHUNK_WORDS)).groupBy("chunk").applyInArrow(chunk, "chunk long, words binary").toLocalIterator():
        words[row["chunk"] * CHUNK_WORDS : (row["chunk"] + 1) * CHUNK_WORDS] = np.frombuffer(row["words"], np.uint32)
    return words


def _size(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2))) if n else 1


def _first_rate(n: int, others: int) -> float:
    """The error rate of level 0 that leaves about as many wrong keys as the list has, or fewer."""
    return min(0.5, max(1e-6, math.sqrt(0.5) * n / max(1, others)))


def build_cascades(listed: DataFrame, universe: DataFrame, *, most_bits: int = MOST_BITS) -> list:
    """Broadcast cascades for `listed` over `universe`, one for each part of the keys by their first digest; both have a column
    key and may hold repeated keys.

    There are as many parts as keep each filter within most_bits, so that a task holds one such filter, whatever the list's
    length. Keys are told apart by two 64-bit digests together. Null keys are left out. An empty list gives one cascade
    without levels, which lists nothing.
    """
    spark = universe.sparkSession
    inside = materialize(listed.where(F.col("key").isNotNull()).select(*digests(F.col("key"))).distinct(), "listed")
    n = inside.count()
    if not n:
        return [spark.sparkContext.broadcast(Cascade())]
    all_keys = universe.where(F.col("key").isNotNull()).select(*digests(F.col("key")))
    total = all_keys.agg(F.approx_count_distinct(F.struct("one", "two"))).first()[0]
    parts = -(-_size(n, _first_rate(n, total - n))[0] // most_bits)
    if parts == 1:
        return [spark.sparkContext.broadcast(_cascade(inside, all_keys, n, total))]
    sizes = {r["part"]: r["n"] for r in inside.groupBy(_part(parts).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for p in range(parts):
        mine, theirs = (side.where(_part(parts) == p) for side in (inside, all_keys))
        found = _cascade(mine, theirs, sizes[p], max(sizes[p], total // parts)) if p in sizes else Cascade()
        out.append(spark.sparkContext.broadcast(found))
    return out


def _part(parts: int) -> Column:
    return F.pmod("one", F.lit(parts))


def build_cascade(listed: DataFrame, universe: DataFrame, *, most_levels: int = 64) -> Cascade:
    """The one cascade for `listed` over `universe`, as long as it comes out; see build_cascades."""
    inside = materialize(listed.where(F.col("key").isNotNull()).select(*digests(F.col("key"))).distinct(), "listed")
    n = inside.count()
    if not n:
        return Cascade()
    all_keys = universe.where(F.col("key").isNotNull()).select(*digests(F.col("key")))
    return _cascade(inside, all_keys, n, all_keys.agg(F.approx_count_distinct(F.struct("one", "two"))).first()[0], most_levels)


def _cascade(inside: DataFrame, all_keys: DataFrame, n: int, total: int, most_levels: int = 64) -> Cascade:
    """The cascade for n distinct digests over those of a universe of some total."""
    spark = inside.sparkSession
    cascade, sides, counts = Cascade(), [inside, all_keys], [n, max(1, total - n)]
    for k in range(most_levels):
        rate = 0.5 if k else _first_rate(n, counts[1])
        bits, hashes = _size(counts[k % 2], rate)
        cascade.levels.append(Level(bits, hashes, _bits_of(sides[k % 2], k, bits, hashes)))
        taken = _tested(spark, sides[1 - k % 2], cascade.levels[-1], k).distinct()
        # of the universe only what the first level takes, listed or not, is ever held against the list
        wrong = materialize(taken if k else taken.join(inside, ["one", "two"], "left_anti"), f"level{k}")
        sides[1 - k % 2], counts[1 - k % 2] = wrong, wrong.count()
        if not counts[1 - k % 2]:
            return cascade
    raise ValueError(f"the cascade did not end after {most_levels} levels")


def _tested(spark: SparkSession, keys: DataFrame, level: Level, k: int) -> DataFrame:
    """The keys that a level takes."""
    shared = spark.sparkContext.broadcast(level)

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (0, 1))
            yield batch.filter(pa.array(shared.value.has(*level_hashes(one, two, k))))

    return keys.mapInArrow(run, keys.schema)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end.
    Both are empty for null and for URLs without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def keep_listed(rows: DataFrame, column: str, cascades: list) -> DataFrame:
    """rows with those elements of a column, an array of strings, that the cascades list, in their order.

    One cascade is asked where the rows are. Of several, each sees the keys of its part, and what they list is brought
    together by row; a row's keys are few."""
    if len(cascades) == 1:
        shared = cascades[0]
        at, width = rows.columns.index(column), len(rows.columns)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                lists, one, two = batch.column(at), *(batch.column(width + k).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
                keep = shared.value.listed_digests(one, two)
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))])
                kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten().filter(pa.array(keep))).cast(lists.type)
                yield pa.RecordBatch.from_arrays([kept if k == at else batch.column(k) for k in range(width)], names=batch.schema.names[:width])

        hashed = rows.select("*", F.transform(column, lambda k: F.xxhash64(k)).alias("one__"), F.transform(column, lambda k: F.xxhash64(k, F.lit("second"))).alias("two__"))
        return hashed.mapInArrow(run, rows.schema)
    numbered = materialize(rows.withColumn("row__", F.monotonically_increasing_id()), "rows")
    long = numbered.select("row__", F.posexplode(column).alias("at", "key")).select("row__", "at", "key", *digests(F.col("key")))

    def asked(shared):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                one, two = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (3, 4))
                yield batch.filter(pa.array(shared.value.listed_digests(one, two)))

        return run

    found = reduce(DataFrame.unionByName, [long.where(_part(len(cascades)) == p).mapInArrow(asked(shared), long.schema) for p, shared in enumerate(cascades)])
    kept = found.groupBy("row__").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("kept__"))
    none = F.array().cast("array<string>")
    return numbered.join(kept, "row__", "left").select(*[F.coalesce("kept__", none).alias(c) if c == column else F.col(c) for c in rows.columns])


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The host's suffixes with as many labels as rule hosts have, the longest first."""
    split = F.split(host, r"\.")
    found = F.array_compact(F.array(*[F.when(F.size(split) > n, F.substring_index(host, ".", -n)).when(F.size(split) == n, host) for n in labels]))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def candidates(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, most_bits: int) -> DataFrame:
    """page_id, host, path and keys, written: the host's listed suffixes with the path's prefixes of the lengths which that
    suffix's own rules have. Other hosts have no keys, however many rules and lengths there are."""
    lengths = [r[0] for r in rules.select("n").distinct().orderBy(F.desc("n")).collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().orderBy(F.desc("n")).collect()]
    none = F.array().cast("array<string>")
    host, path = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = materialize(urls.withColumn("keys", host_suffixes(F.col("host"), labels) if labels else none), "hosts")
    suffixes = urls.select(F.explode("keys").alias("key"))
    urls = materialize(keep_listed(urls, "keys", build_cascades(rules.select(F.col("rule_host").alias("key")), suffixes, most_bits=most_bits)), "listed_hosts")
    place = lambda n, h: F.concat(n.cast("string"), F.lit(" "), h)
    every = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    seen = urls.select(F.explode("keys").alias("seen")).distinct()
    places = seen.select(F.explode(F.transform(every, lambda n: place(n, F.col("seen")))).alias("key"))
    has_length = build_cascades(rules.select(place(F.col("n"), F.col("rule_host")).alias("key")), places, most_bits=most_bits)
    fits = F.filter(every, lambda n: n <= F.length("path"))
    urls = urls.withColumn("keys", F.flatten(F.transform("keys", lambda h: F.transform(fits, lambda n: place(n, h)))))
    urls = keep_listed(urls, "keys", has_length)
    length = lambda k: F.substring_index(k, " ", 1)
    key = lambda k: F.concat(F.substr(k, F.length(length(k)) + 2), F.substr(F.col("path"), F.lit(1), length(k).cast("int")))
    return materialize(urls.withColumn("keys", F.array_distinct(F.transform("keys", key))), "keys")


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules has host, path and verdict.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path; the longest
    (host and path together) wins. URLs that no rule fits get `default`, as nothing lists them. Verdicts are
    decided by cascades over the corpus's keys: which suffixes are rules' hosts, which lengths their paths have, which keys are
    rules, and which rules block. Null URLs and those without :// have an empty host and path and fit no rule. Repeated rows
    are judged row by row; a rule that is listed twice must not contradict itself (blocking wins). An empty list gives every
    URL `default`, an empty table no rows; very long URLs are judged whole. The rules' distinct path lengths and numbers
    of labels are collected, nothing else of them; a list of any length is split so that no filter exceeds most_bits.
    """
    rule_host, rule_path = F.lower("host"), F.coalesce("path", F.lit("/"))
    clean = rules.where(F.col("host").isNotNull()).select(rule_host.alias("rule_host"), F.concat(rule_host, rule_path).alias("key"), F.length(rule_path).alias("n"), "verdict")
    urls = candidates(pages, clean, id_col, url_col, most_bits)
    is_rule = build_cascades(clean.select("key"), urls.select(F.explode("keys").alias("key")), most_bits=most_bits)
    blocks = build_cascades(clean.where(F.col("verdict") == "block").select("key"), clean.select("key"), most_bits=most_bits)
    found = keep_listed(urls, "keys", is_rule)
    # of equally long ones the first, whose host is longest
    best = F.array_max(F.transform("keys", lambda k, i: F.struct(F.length(k).alias("n"), (-i).alias("place"), k.alias("key"))))["key"]
    ruled = found.select("page_id", "host", "path", F.array_compact(F.array(best)).alias("rule"))
    rule = F.get("rule", F.lit(0))
    blocked = keep_listed(ruled.withColumn("blocked", F.col("rule")), "blocked", blocks)
    verdict = F.when(rule.isNull(), F.lit(default)).when(F.size("blocked") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return blocked.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
