"""Stacked predictions: models that are fitted and weighed on different rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Fits on some rows and gives a function that adds a column of predictions, by a name, to any rows.
Learner = Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]]


@dataclass
class Stack:
    """Weights by model, the squared errors (mean) of each model and of the stack on rows that they were not fitted on, and the
    models fitted on all rows."""

    weights: dict[str, float]
    errors: dict[str, float]
    models: dict[str, Callable[[DataFrame, str], DataFrame]]

    def predict(self, rows: DataFrame, name: str = "stacked") -> DataFrame:
        """rows with the predictions of all models, by their names, and the weighted one."""
        for m, add in self.models.items():
            rows = add(rows, m)
        return rows.withColumn(name, sum((F.col(m) * w for m, w in self.weights.items()), F.lit(0.0)))


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The weights of at least 0 that sum to 1 and make w'Gw - 2c'w smallest: the best of the exact solutions on all subsets
    of models, of which there are few."""
    m, best, found = len(cross), np.inf, np.zeros(len(cross))
    for size in range(1, m + 1):
        for held in combinations(range(m), size):
            g = gram[np.ix_(held, held)]
            system = np.block([[2 * g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            solved = np.linalg.lstsq(system, np.append(2 * cross[list(held)], 1.0), rcond=None)[0][:size]
            if (solved < -1e-12).any() or abs(solved.sum() - 1) > 1e-6:
                continue
            w = np.zeros(m)
            w[list(held)] = np.maximum(solved, 0)
            w /= w.sum()
            value = w @ gram @ w - 2 * cross @ w
            if value < best - 1e-12 * max(1.0, abs(best) if np.isfinite(best) else 1.0):
                best, found = value, w
    return found


def fit_stack(rows: DataFrame, key: str, label: Column, learners: Mapping[str, Learner], *, folds: int = 3, seed: int = 42) -> Stack:
    """Each model is fitted on all folds but one and predicts that one; the weights are those of the least squared error
    over all such predictions, from one aggregate of their products; then every model is fitted on all rows.

    Folds come from hashes of the key, so that rows which share a key share a fold and reruns agree. Rows without a label
    go; a null prediction is the mean label. At most ten models."""
    names = list(learners)
    if not 1 <= len(names) <= 10:
        raise ValueError("a stack has one to ten models")
    data = written(rows.withColumns({"label__": label.cast("double"), "fold__": F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))}).where("label__ is not null"), "stack")
    parts = []
    for fold in range(folds):
        held, rest = data.where(F.col("fold__") == fold), data.where(F.col("fold__") != fold)
        for i, name in enumerate(names):
            held = learners[name](rest)(held, f"p{i}__")
        parts.append(held.select("label__", *[f"p{i}__" for i in range(len(names))]))
    mean = data.agg(F.avg("label__")).first()[0] or 0.0
    # centred by the mean label, which the weights' sum of 1 allows
    said = [F.coalesce(F.col(f"p{i}__"), F.lit(mean)) - F.lit(mean) for i in range(len(names))]
    centred = reduce(DataFrame.unionByName, parts).select((F.col("label__") - F.lit(mean)).alias("y"), *[s.alias(f"s{i}") for i, s in enumerate(said)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col("y") * F.col(f"s{i}")).alias(f"c{i}") for i in range(len(names))], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    n = sums["n"]
    if not n:
        raise ValueError("a stack needs rows with a label")
    gram, cross = np.zeros((len(names), len(names))), np.array([sums[f"c{i}"] / n for i in range(len(names))])
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] / n
    weights = simplex_weights(gram, cross)
    error = lambda w: float(sums["yy"] / n + w @ gram @ w - 2 * cross @ w)
    errors = {name: error(np.eye(len(names))[i]) for i, name in enumerate(names)} | {"stacked": error(weights)}
    return Stack(dict(zip(names, weights.tolist(), strict=True)), errors, {name: learners[name](data) for name in names})
