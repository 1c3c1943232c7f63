"""Boosted trees with quantile and Huber losses on histograms that Spark sums, and exact attribution to features.

Rows are binned once and written. Each level of a round is one pass: tasks run the trees over their batches and emit, for
every node, feature and bin, the number of rows and the sum of gradients; Spark adds these up, and the driver, which sees
histograms alone, picks the splits. Gradients are whole numbers, so that sums do not depend on the order of rows or
tasks. Several losses are fitted side by side in the same passes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: A gradient of 1 in whole numbers, and cells of the grid that residuals are counted in.
UNIT, GRID = 1 << 20, 2048


@dataclass(frozen=True)
class Pinball:
    """The loss whose minimum is a quantile; a leaf moves by that quantile of its residuals."""

    q: float

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        return np.where(residual > 0, round(self.q * UNIT), round((self.q - 1) * UNIT))

    def step(self, counts: np.ndarray, total: int, span: float) -> float:
        return grid_quantile(counts, self.q, span)


@dataclass(frozen=True)
class Huber:
    """Squared loss near the label and absolute loss beyond delta; a leaf moves by the mean clipped residual."""

    delta: float

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(residual / self.delta, -1, 1) * UNIT)

    def step(self, counts: np.ndarray, total: int, span: float) -> float:
        return total / max(1, counts.sum()) * self.delta / UNIT


def grid_quantile(counts: np.ndarray, q: float, span: float) -> float:
    """The quantile of residuals counted in GRID cells over [-span, span], linear within its cell."""
    if not counts.sum():
        return 0.0
    upto, want = np.cumsum(counts), q * counts.sum()
    at = int(np.searchsorted(upto, want))
    inside = (want - (upto[at] - counts[at])) / counts[at]
    return float((at + inside) / GRID * 2 * span - span)


@dataclass
class Tree:
    """A complete tree in heap order. Rows whose bin is at most the node's go left; where nothing is gained all do."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.zeros(inner, np.int64), np.full(inner, 255), np.zeros(inner + 1), np.zeros(2 * inner + 1, np.int64))

    def node(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at a depth, in heap order."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (bins[np.arange(len(bins)), self.feature[at]] > self.bin[at])
        return at

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        depth = len(self.value).bit_length() - 1
        return self.value[self.node(bins, depth) - len(self.feature)]


@dataclass
class Boosted:
    """A fitted model: names and bin edges of its features, and for every loss its start and trees."""

    features: list[str]
    edges: list[np.ndarray]
    losses: list
    start: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Values as bins; what is missing falls into the lowest."""
        filled = np.where(np.isnan(values), -np.inf, values)
        return np.stack([np.searchsorted(e, filled[:, j]) for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """The trees' sums by row and loss, without the start."""
        return np.stack([sum((t(bins) for t in trees[since:]), np.zeros(len(bins))) for trees in self.trees], axis=1)

    def predict(self) -> Column:
        """An array with a prediction for every loss, from columns named like the features."""
        start = np.array(self.start)

        @F.pandas_udf("array<double>")
        def run(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(list(start + self.margins(self.bins(frame[self.features].to_numpy(float)))))

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))

    def attribute(self, loss: int = 0) -> Column:
        """An array with each feature's Shapley value in the prediction of a loss; they add up to the prediction less the
        mean prediction of the train rows. What a tree would say without a feature is the average over its train rows."""

        @F.pandas_udf("array<double>")
        def run(frame: pd.DataFrame) -> pd.Series:
            bins = self.bins(frame[self.features].to_numpy(float))
            return pd.Series(list(sum((attribution(t, bins) for t in self.trees[loss]), np.zeros(bins.shape))))

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))


def attribution(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Shapley values of one tree by row and feature. A leaf is a product over the features on its path: 1 or 0 as the row
    goes its way if the feature is known, else the share of train rows that do; so each leaf is a game of its few
    features, whose subsets are enumerated."""
    inner = len(tree.feature)
    out = np.zeros(bins.shape)
    for leaf in range(inner, 2 * inner + 1):
        if not tree.cover[leaf] or not tree.value[leaf - inner]:
            continue
        follows: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        at = leaf
        while at:
            up = (at - 1) // 2
            j, right = int(tree.feature[up]), at == 2 * up + 2
            if tree.cover[at] < tree.cover[up] or right:
                goes = (bins[:, j] > tree.bin[up]) == right
                follows[j] = follows[j] & goes if j in follows else goes
                share[j] = share.get(j, 1.0) * tree.cover[at] / tree.cover[up]
            at = up
        names = list(follows)
        for j in names:
            others = [i for i in names if i != j]
            for size in range(len(others) + 1):
                weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(names))
                for known in itertools.combinations(others, size):
                    rest = math.prod(share[i] for i in others if i not in known)
                    on = np.logical_and.reduce([follows[i] for i in known]) if known else np.ones(len(bins), bool)
                    out[:, j] += weight * tree.value[leaf - inner] * rest * on * (follows[j] - share[j])
    return out


def mean_margin(tree: Tree) -> float:
    """The tree's mean over its train rows."""
    inner = len(tree.feature)
    return float((tree.cover[inner:] * tree.value).sum() / max(1, tree.cover[0]))


def best_split(n: np.ndarray, g: np.ndarray, least: int) -> tuple[int, int] | None:
    """Feature and bin with the largest gain in squared gradient sums per row, from histograms [feature, bin]; the first
    of equal ones, None where nothing is gained or a side would have fewer than `least` rows."""
    left_n, left_g = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    total_n, total_g = n[0].sum(), g[0].sum()
    right_n, right_g = total_n - left_n, total_g - left_g
    fits = (left_n >= least) & (right_n >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_g.astype(float) ** 2 / left_n + right_g.astype(float) ** 2 / right_n, -1.0)
    at = int(gain.argmax())
    if not fits.any() or gain.flat[at] <= float(total_g) ** 2 / total_n * (1 + 1e-12):
        return None
    return divmod(at, gain.shape[1])


def fit_boosted(rows: DataFrame, label: Column, features: Sequence[str], losses: Sequence, *, rounds: int = 20, depth: int = 3, rate: float = 0.3, max_bins: int = 64, least: int = 20, rewrite: int = 10) -> Boosted:
    """A model of the label for each loss. Rows without a label are left out; missing features count as lowest.

    Rounds times depth + 1 passes over the binned rows, of a byte a feature; predictions so far are written with them
    every `rewrite` rounds. Bin edges are approximate quantiles. An empty table gives a model without trees that says 0.
    """
    features, losses = list(features), list(losses)
    wide = rows.select(label.cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]).where(F.col("label").isNotNull() & ~F.isnan("label"))
    probs = [k / max_bins for k in range(1, max_bins)]
    ends = wide.agg(F.min("label").alias("low"), F.max("label").alias("high"), *[F.percentile_approx(c, probs, 10_000).alias(f"e{j}") for j, c in enumerate(features)]).first()
    edges = [np.unique(np.array(ends[f"e{j}"] or [0.0], float)) for j in range(len(features))]
    model = Boosted(features, edges, losses, [0.0] * len(losses), [[] for _ in losses])
    if ends["low"] is None:
        return model
    span = max(ends["high"] - ends["low"], 1e-9)
    middle = (ends["high"] + ends["low"]) / 2

    def binned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            values = np.stack([b.column(j + 1).to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in model.bins(values)], pa.binary()), pa.array([b""] * b.num_rows, pa.binary())], names=["label", "bins", "margin"])

    data = written(wide.mapInArrow(binned, "label double, bins binary, margin binary"), "binned")
    level_slots = len(features) * 256

    def decode_bins(batch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(features))

    def decoded(batch, fitted: Boosted, since: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins and residuals of a batch, by row and loss."""
        bins = decode_bins(batch)
        margin = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(batch.num_rows, -1) if since else 0.0
        return bins, batch.column(0).to_numpy()[:, None] - np.array(fitted.start) - margin - fitted.margins(bins, since)

    def histograms(trees: list[Tree], at_depth: int, since: int, leaves: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each loss numbers of rows and sums of gradients by node, feature and bin; at the leaves by node and grid
        cell."""
        slots = GRID if leaves else level_slots

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            n = np.zeros((len(losses), slots << at_depth), np.int64)
            g = np.zeros((len(losses), slots << at_depth))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, residuals = decoded(batch, model, since)
                for k, loss in enumerate(losses):
                    r = residuals[:, k]
                    grad = loss.gradient(r).astype(float)
                    node = trees[k].node(bins, at_depth) - ((1 << at_depth) - 1)
                    if leaves:
                        place = [node * GRID + np.clip(np.floor((r + span) / (2 * span) * GRID), 0, GRID - 1).astype(np.int64)]
                    else:
                        place = [node * slots + j * 256 + bins[:, j] for j in range(len(features))]
                    for p in place:
                        n[k] += np.bincount(p, minlength=slots << at_depth)
                        g[k] += np.bincount(p, grad, minlength=slots << at_depth)
            loss_at, slot = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(loss_at, pa.int32()), pa.array(slot, pa.int64()), pa.array(n[loss_at, slot], pa.int64()), pa.array(g[loss_at, slot].astype(np.int64), pa.int64())], names=["loss", "slot", "n", "g"])

        sums = data.mapInArrow(run, "loss int, slot long, n long, g long").groupBy("loss", "slot").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        out = [(np.zeros(slots << at_depth, np.int64), np.zeros(slots << at_depth, np.int64)) for _ in losses]
        loss_at, slot, n, g = (c.to_numpy() for c in sums.toArrow().columns)
        for k, (numbers, totals) in enumerate(out):
            mine = loss_at == k
            numbers[slot[mine]], totals[slot[mine]] = n[mine], g[mine]
        return out

    # the start: a step from the label's middle by all rows
    model.start = [middle] * len(losses)
    first = histograms([Tree.empty(0) for _ in losses], 0, 0, True)
    model.start = [middle + loss.step(n, int(g.sum()), span) for loss, (n, g) in zip(losses, first, strict=True)]
    since = 0
    for done in range(rounds):
        trees = [Tree.empty(depth) for _ in losses]
        for level in range(depth):
            for tree, (n, g) in zip(trees, histograms(trees, level, since, False), strict=True):
                for node in range(1 << level):
                    own = slice(node * level_slots, (node + 1) * level_slots)
                    by_bin, grads = n[own].reshape(-1, 256), g[own].reshape(-1, 256)
                    tree.cover[(1 << level) - 1 + node] = by_bin[0].sum()
                    if split := best_split(by_bin, grads, least) if by_bin[0].sum() else None:
                        tree.feature[(1 << level) - 1 + node], tree.bin[(1 << level) - 1 + node] = split
        for loss, tree, (n, g) in zip(losses, trees, histograms(trees, depth, since, True), strict=True):
            for leaf in range(1 << depth):
                own = slice(leaf * GRID, (leaf + 1) * GRID)
                tree.cover[(1 << depth) - 1 + leaf] = n[own].sum()
                tree.value[leaf] = rate * loss.step(n[own], int(g[own].sum()), span)
        for k, tree in enumerate(trees):
            model.trees[k].append(tree)
        if (done + 1) % rewrite == 0 and done + 1 < rounds:

            def with_margin(batches: Iterator) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    bins = decode_bins(batch)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in model.margins(bins)], pa.binary())], names=["label", "bins", "margin"])

            data = written(data.mapInArrow(with_margin, "label double, bins binary, margin binary"), "margins")
            since = done + 1
    return model


def target_means(rows: DataFrame, train: Column, column: str, label: Column, strength: float = 20.0) -> DataFrame:
    """rows with column__mean: a category's mean label over the train rows, drawn to the overall mean as by `strength`
    rows; unseen and missing categories get the overall mean."""
    data = rows.where(train).select(F.col(column).alias("level"), label.cast("double").alias("y")).where("y is not null")
    prior = data.agg(F.avg("y")).first()[0] or 0.0
    means = data.groupBy("level").agg(((F.sum("y") + strength * prior) / (F.count(F.lit(1)) + strength)).alias("mean"))
    joined = rows.join(means, rows[column].eqNullSafe(means["level"]), "left")
    return joined.withColumn(f"{column}__mean", F.coalesce("mean", F.lit(prior))).drop("level", "mean")
