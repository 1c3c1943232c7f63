"""Random survival forest: log-rank splits from histograms of events and rows at risk, cumulative hazards by leaf.

All trees grow together, a level a pass: tasks weigh their rows by a Poisson draw for every tree (a bootstrap that is
the same in every pass, as it hashes the row's key), find each row's node and count rows and events by node, drawn
feature, bin and time cell; Spark adds these up and the driver, which sees counts alone, picks the splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Shares of the Poisson distribution with mean 1 up to 0, 1, 2 .. rows.
POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap takes each row."""
    x = _mixed(hashes.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), "right")


def log_rank(events: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-rank chi square of a split after each bin but the last, from counts [bin, time] of events and of all rows that
    end in a time cell; 0 where a side has no rows or nothing varies."""
    at_risk = np.cumsum(rows[:, ::-1], axis=1)[:, ::-1].astype(float)
    d, n = events.sum(axis=0), at_risk.sum(axis=0)
    left_d, left_n = np.cumsum(events, axis=0)[:-1], np.cumsum(at_risk, axis=0)[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, left_n / n, 0.0)
        u = (left_d - d * share).sum(axis=1)
        v = np.where(n > 1, d * share * (1 - share) * (n - d) / (n - 1), 0.0).sum(axis=1)
        return np.where(v > 1e-12, u * u / v, 0.0)


def best_split(events: np.ndarray, rows: np.ndarray, least: int) -> tuple[int, int] | None:
    """Feature (its place among the drawn ones) and bin with the greatest log-rank, from counts [feature, bin, time];
    the first of equal ones, None if no split leaves `least` rows on both sides and sets them apart at all."""
    found, best = None, 0.0
    for j in range(len(rows)):
        left = np.cumsum(rows[j].sum(axis=1))[:-1]
        chi = np.where((left >= least) & (rows[j].sum() - left >= least), log_rank(events[j], rows[j]), 0.0)
        if len(chi) and chi.max() > best * (1 + 1e-12):
            found, best = (j, int(chi.argmax())), float(chi.max())
    return found


@dataclass
class Forest:
    """Features with bin edges, time cells' ends, and by tree the nodes' features and bins and the leaves' cumulative hazards."""

    features: list[str]
    edges: list[np.ndarray]
    times: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    hazard: np.ndarray

    def bins(self, values: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(values), -np.inf, values)
        return np.stack([np.searchsorted(e, filled[:, j]) for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def node(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (bins[np.arange(len(bins)), self.feature[tree][at]] > self.bin[tree][at])
        return at

    def cumulative(self, bins: np.ndarray) -> np.ndarray:
        """The trees' mean cumulative hazard by row and time cell."""
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        total = np.zeros((len(bins), len(self.times)))
        for t in range(len(self.feature)):
            total += self.hazard[t][self.node(t, bins, depth) - inner]
        return total / max(1, len(self.feature))

    def predict(self) -> Column:
        """A struct: risk, the expected number of events over the time cells (ensemble mortality), and p50, the end of the
        first cell by which survival has fallen to a half (null if it never does)."""

        @F.pandas_udf("risk double, p50 double")
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            h = self.cumulative(self.bins(frame[self.features].to_numpy(float)))
            gone = h >= np.log(2)
            first = np.where(gone.any(axis=1), self.times[gone.argmax(axis=1)], np.nan)
            return pd.DataFrame({"risk": np.round(h.sum(axis=1), 9), "p50": pd.Series(first).astype(object).where(~np.isnan(first), None)})

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))


def fit_forest(rows: DataFrame, key: str, time: str, event: Column, features: Sequence[str], *, trees: int = 30, depth: int = 4, draws: int | None = None, max_bins: int = 32, cells: int = 32, least: int = 15, seed: int = 42) -> Forest:
    """A forest of `trees` trees, each node of which considers `draws` features (the square root of their number).

    Rows without a time are left out, missing features count as lowest. Time cells are quantiles of event times, so that
    equal times share a cell. depth + 1 passes over rows of a byte a feature, whatever the number of trees. An empty
    table gives hazards of 0.
    """
    features = list(features)
    draws = draws or max(1, round(len(features) ** 0.5))
    wide = rows.select(F.xxhash64(key).alias("hash"), F.col(time).cast("double").alias("time"), F.coalesce(event, F.lit(False)).cast("int").alias("event"), *[F.col(c).cast("double").alias(c) for c in features])
    wide = wide.where(F.col("time").isNotNull() & ~F.isnan("time"))
    probs = lambda n: [k / n for k in range(1, n)]
    found = wide.agg(F.percentile_approx(F.when(F.col("event") == 1, F.col("time")), probs(cells), 10_000).alias("times"), F.max("time").alias("last"), *[F.percentile_approx(c, probs(max_bins), 10_000).alias(f"e{j}") for j, c in enumerate(features)]).first()
    edges = [np.unique(np.array(found[f"e{j}"] or [0.0], float)) for j in range(len(features))]
    times = np.unique(np.array([*(found["times"] or []), found["last"] or 0.0], float))
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    drawn = np.array([[np.sort(rng.choice(len(features), draws, replace=False)) for _ in range(inner)] for _ in range(trees)])
    forest = Forest(features, edges, times, np.zeros((trees, inner), np.int64), np.full((trees, inner), 255), np.zeros((trees, inner + 1, len(times))))

    def binned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            values = np.stack([b.column(j + 3).to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))], axis=1)
            cell = np.searchsorted(times, b.column(1).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), b.column(2), pa.array([x.tobytes() for x in forest.bins(values)], pa.binary())], names=["hash", "cell", "event", "bins"])

    data = written(wide.mapInArrow(binned, "hash long, cell int, event int, bins binary"), "forest")
    n_bins, n_cells = max_bins, len(times)

    def counts(level: int) -> np.ndarray:
        """[event or row, tree, node, drawn feature, bin, cell]; at the leaves one feature with one bin."""
        leaves = level == depth
        shape = (trees, 1 << level, 1 if leaves else draws, 1 if leaves else n_bins, n_cells)
        size = int(np.prod(shape[1:]))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            out = np.zeros((2, trees, size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                hashes, cell, happened = (batch.column(k).to_numpy() for k in range(3))
                bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for t in range(trees):
                    weight = drawn_weights(hashes, t, seed)
                    node = forest.node(t, bins, level)
                    base = node - ((1 << level) - 1)
                    for s in range(1 if leaves else draws):
                        at = base * n_cells + cell if leaves else ((base * draws + s) * n_bins + bins[np.arange(len(bins)), drawn[t][node, s]]) * n_cells + cell
                        out[0, t] += np.bincount(at, weight * happened, size)
                        out[1, t] += np.bincount(at, weight, size)
            slot = np.flatnonzero(out[1].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), *[pa.array(x.ravel()[slot].astype(np.int64)) for x in out]], names=["slot", "events", "n"])

        sums = data.mapInArrow(run, "slot long, events long, n long").groupBy("slot").agg(F.sum("events").alias("events"), F.sum("n").alias("n"))
        slot, events, n = (c.to_numpy() for c in sums.toArrow().columns)
        out = np.zeros((2, trees * size), np.int64)
        out[0, slot], out[1, slot] = events, n
        return out.reshape(2, *shape)

    for level in range(depth):
        events, n = counts(level)
        for t in range(trees):
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                if split := best_split(events[t, i], n[t, i], least):
                    forest.feature[t, node], forest.bin[t, node] = drawn[t][node, split[0]], split[1]
    events, n = (x[:, :, 0, 0] for x in counts(depth))
    at_risk = np.cumsum(n[:, :, ::-1], axis=2)[:, :, ::-1]
    forest.hazard = np.cumsum(np.where(at_risk > 0, events / np.maximum(at_risk, 1), 0.0), axis=2)
    return forest


def permutation_importance(rows: DataFrame, forest: Forest, key: str, score) -> list[tuple[str, float]]:
    """For each feature by how much score(rows with a column risk) falls when the feature's values change hands: each row
    takes that of another with a near hash, so that nothing is gathered and reruns agree."""
    buckets = max(1, rows.count() // 20_000)
    whole = score(rows.withColumn("risk", forest.predict()["risk"]))
    out = []
    for f in forest.features:
        # hashes deal the rows into even buckets, in which each takes the next one's value, the last the first's
        own = W.partitionBy(F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets))).orderBy(F.xxhash64(key, F.lit(f)), key)
        moved = rows.withColumn(f, F.coalesce(F.lead(f).over(own), F.first(f).over(own)))
        out.append((f, whole - score(moved.withColumn("risk", forest.predict()["risk"]))))
    return out
