"""Similar historical cases: Gower and hybrid similarity, two-stage pools, confidence, weighted quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Combinations of other features than the number that are held at once to bound similarities; beyond them the bound is 1.
MOST_CELLS = 10_000


def gower(numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], a: str = "q", b: str = "c") -> Column:
    """Weighted Gower distance between struct columns a and b: numbers by their range, categories by equality,
    features with a null left out and the weights renormalised; 1 without any feature."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for f in (*numeric, *categorical):
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        d = F.least(F.lit(1.0), F.abs(x - y) / max(numeric[f], 1e-6)) if f in numeric else (x != y).cast("double")
        known = x.isNotNull() & y.isNotNull()
        total += F.when(known, weights[f] * d).otherwise(0.0)
        weight += F.when(known, F.lit(weights[f])).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(1.0)


def _first_k(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest values, the smaller id first among equal ones."""
    least = np.partition(sims, -k, axis=1)[:, [-k]] if sims.shape[1] > k else -np.inf
    rows, cols = np.nonzero((sims >= least) & (sims > -np.inf))
    order = np.lexsort((ids[cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept]


def _pairs(x, y, of: Sequence, numeric: Mapping[str, float], weights: Mapping[str, float], number: str):
    """1 - gower to 9 places of numbers x and y (arrays that broadcast, or nulls) and the other features' parts, in the order
    in which gower adds them; of holds a feature's name, its part and whether both sides know it."""
    total, weight = 0.0, 0.0
    for f, d, known in of:
        if f == number:
            d, known = np.minimum(1.0, np.abs(x - y) / max(numeric[f], 1e-6)), ~np.isnan(x) & ~np.isnan(y)
        total = total + np.where(known, weights[f] * d, 0.0)
        weight = weight + np.where(known, weights[f], 0.0)
    return np.round(1 - np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), 1.0), 9)


def _missing(v) -> bool:
    return v is None or v != v


def _parts_of(values: Sequence, cells: Sequence[np.ndarray], features: Sequence[str], numeric: Mapping[str, float], number: str) -> list:
    """For _pairs: each feature's name, the part of the distance that lies between the values and each of the cells (by
    feature, nulls as None or NaN) and whether both know it."""
    out, others = [], iter(zip(values, cells, strict=True))
    for f in features:
        if f == number:
            out.append((f, 0.0, True))
            continue
        x, y = next(others)
        known = ~np.isnan(y) if f in numeric else np.array([not _missing(v) for v in y], bool)
        if _missing(x):
            out.append((f, np.zeros(len(y)), np.zeros(len(y), bool)))
        elif f in numeric:
            out.append((f, np.minimum(1.0, np.abs(float(x) - np.where(known, y, 0.0)) / max(numeric[f], 1e-6)), known))
        else:
            out.append((f, (y != x).astype(float), known))
    return out


def _columns(cells: Sequence[tuple], others: Sequence[str], numeric: Mapping[str, float]) -> list[np.ndarray]:
    """The cells' values by feature."""
    out = []
    for j, f in enumerate(others):
        column = np.empty(len(cells), object)
        column[:] = [c[j] for c in cells]
        out.append(np.array([np.nan if _missing(v) else float(v) for v in column]) if f in numeric else column)
    return out


def _cells(frame: pd.DataFrame, by: Sequence[str]) -> list[tuple[tuple, np.ndarray]]:
    """Values of `by` and the places of their rows, nulls as a value of their own."""
    if not by:
        return [((), np.arange(len(frame)))] if len(frame) else []
    codes = np.stack([pd.factorize(frame[f])[0] for f in by], axis=1)
    _, first, cell = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(cell.ravel(), kind="stable")
    ends = np.flatnonzero(np.diff(cell.ravel()[order], prepend=-1, append=len(first)))
    values = [frame[f].to_numpy(object) for f in by]
    return [(tuple(None if _missing(v[at]) else v[at] for v in values), order[x:y]) for at, x, y in zip(first, ends, ends[1:])]


class _Nearest:
    """A block's cases by cell, sorted by the number, for the k best of each query.

    In a cell a similarity depends on the difference of the numbers alone, so that the best are around the query's own
    number; of cases with the same features only the k + 1 smallest keys can be among the best. Cells are taken from the
    one with the highest bound down, until the bound of the next is below what a query has."""

    def __init__(self, c: pd.DataFrame, key: str, numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], number: str, first_stage: str, k: int):
        self.features, self.numeric, self.weights, self.number, self.key, self.k = [*numeric, *categorical], numeric, weights, number, key, k
        self.others = [f for f in self.features if f != number]
        self.cells = []
        for first in (True, False):
            rows = np.flatnonzero(c[first_stage].fillna(False).to_numpy(bool) == first)
            part = c.iloc[rows]
            x, ids = part[number].to_numpy(float), part[key].to_numpy()
            for cell, at in _cells(part, self.others):
                at = at[np.lexsort((ids[at], x[at]))]
                new = np.flatnonzero(np.append(True, (np.diff(x[at]) != 0) & ~(np.isnan(x[at][1:]) & np.isnan(x[at][:-1]))))
                at = at[np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))) <= k]
                known = int((~np.isnan(x[at])).sum())
                for some in (at[:known], at[known:]):  # cases without the number are all alike
                    if len(some):
                        self.cells.append((first, cell, x[some], ids[some], rows[some]))
        self.columns = _columns([c[1] for c in self.cells], self.others, numeric)
        self.first, self.unnumbered = np.array([c[0] for c in self.cells], bool), np.array([np.isnan(c[2][0]) for c in self.cells], bool)

    def _around(self, q: np.ndarray, own: np.ndarray, cell: tuple, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, similarities and places in the cell of each query's k best cases of it."""
        _, _, x, ids, _ = cell
        out, width, asked = [], 2 * (self.k + 1), np.arange(len(q))
        while len(asked):
            left_over = []
            for some in np.array_split(asked, max(1, len(asked) * 2 * min(width, len(x)) // 2_000_000)):
                if not len(some):
                    continue
                if len(x) <= 2 * width:
                    places, whole = np.broadcast_to(np.arange(len(x)), (len(some), len(x))), True
                else:
                    start = np.clip(np.searchsorted(x, q[some]) - width, 0, len(x) - 2 * width)
                    places, whole = start[:, None] + np.arange(2 * width), False
                sims = _pairs(q[some][:, None], x[places], parts, self.numeric, self.weights, self.number)
                sims = np.where(ids[places] == own[some][:, None], -np.inf, sims)
                done = np.ones(len(some), bool)
                if not whole:  # the next case outside must be worse than the k-th inside
                    kth = -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1]
                    low, high = np.maximum(places[:, 0] - 1, 0), np.minimum(places[:, -1] + 1, len(x) - 1)
                    far = lambda at: _pairs(q[some], x[at], parts, self.numeric, self.weights, self.number)
                    done = ((places[:, 0] == 0) | (far(low) < kth)) & ((places[:, -1] == len(x) - 1) | (far(high) < kth))
                    left_over.append(some[~done])
                if done.any():
                    at, col = _first_k_of(sims[done], ids[places[done]], self.k)
                    out.append((some[done][at], sims[done][at, col], places[done][at, col]))
            asked, width = np.concatenate(left_over) if left_over else np.array([], int), 2 * width
        if not out:
            return np.array([], int), np.array([]), np.array([], int)
        return tuple(np.concatenate(z) for z in zip(*out))

    def best(self, q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, rows of the block and similarities: each query's k best, and its k best of the first stage."""
        out = []
        for values, rows in _cells(q, self.others):
            x, own = q[self.number].to_numpy(float)[rows], q[self.key].to_numpy()[rows]
            every = _parts_of(values, self.columns, self.features, self.numeric, self.number)
            same, without = (np.broadcast_to(_pairs(np.float64(v), np.float64(0), every, self.numeric, self.weights, self.number), len(self.cells)) for v in (0, np.nan))
            numbered = np.where(self.unnumbered, without, same)
            unknown = np.isnan(x)
            most = np.where(unknown.any(), np.maximum(numbered, without), numbered)
            tops = {stage: np.full((len(rows), self.k), -np.inf) for stage in (True, False)}
            for j in np.argsort(-most, kind="stable"):
                if most[j] < tops[False][:, -1].min() and most[j] < tops[True][:, -1].min():
                    break
                cell = self.cells[j]
                bound = np.where(unknown, without[j], numbered[j])
                due = bound >= tops[False][:, -1]
                if cell[0]:
                    due |= bound >= tops[True][:, -1]
                asked = np.flatnonzero(due)
                if not len(asked):
                    continue
                parts = [(f, 0.0, True) if f == self.number else (f, d[j], known[j]) for f, d, known in every]
                at, sims, places = self._around(x[asked], own[asked], cell, parts)
                at = asked[at]
                out.append((rows[at], cell[4][places], sims))
                order = np.argsort(at, kind="stable")
                at, sims = at[order], sims[order]
                first = np.searchsorted(at, at)
                for stage in (True, False) if cell[0] else (False,):
                    found = np.full((len(rows), self.k), -np.inf)
                    found[at, np.arange(len(at)) - first] = sims
                    tops[stage] = -np.sort(-np.concatenate([tops[stage], found], axis=1), axis=1)[:, : self.k]
        if not out:
            return np.array([], int), np.array([], int), np.array([])
        return tuple(np.concatenate(z) for z in zip(*out))


def _first_k_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest values over minus infinity, the smaller of its ids first among equal ones."""
    least = -np.partition(-sims, k - 1, axis=1)[:, [k - 1]] if sims.shape[1] > k else -np.inf
    rows, cols = np.nonzero((sims >= least) & (sims > -np.inf))
    order = np.lexsort((ids[rows, cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept]


def _pairs(x, y, of: Sequence, numeric: Mapping[str, float], weights: Mapping[str, float], number: str):
    """1 - gower to 9 places of numbers x and y (arrays that broadcast, or nulls) and the other features' parts, in the order
    in which gower adds them; of holds a feature's name, its part and whether both sides know it."""
    total, weight = 0.0, 0.0
    for f, d, known in of:
        if f == number:
            d, known = np.minimum(1.0, np.abs(x - y) / max(numeric[f], 1e-6)), ~np.isnan(x) & ~np.isnan(y)
        total = total + np.where(known, weights[f] * d, 0.0)
        weight = weight + np.where(known, weights[f], 0.0)
    return np.round(1 - np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), 1.0), 9)


def _missing(v) -> bool:
    return v is None or v != v


def _parts_of(values: Sequence, cells: Sequence[np.ndarray], features: Sequence[str], numeric: Mapping[str, float], number: str) -> list:
    """For _pairs: each feature's name, the part of the distance that lies between the values and each of the cells (by
    feature, nulls as None or NaN) and whether both know it."""
    out, others = [], iter(zip(values, cells, strict=True))
    for f in features:
        if f == number:
            out.append((f, 0.0, True))
            continue
        x, y = next(others)
        known = ~np.isnan(y) if f in numeric else np.array([not _missing(v) for v in y], bool)
        if _missing(x):
            out.append((f, np.zeros(len(y)), np.zeros(len(y), bool)))
        elif f in numeric:
            out.append((f, np.minimum(1.0, np.abs(float(x) - np.where(known, y, 0.0)) / max(numeric[f], 1e-6)), known))
        else:
            out.append((f, (y != x).astype(float), known))
    return out


def _columns(cells: Sequence[tuple], others: Sequence[str], numeric: Mapping[str, float]) -> list[np.ndarray]:
    """The cells' values by feature."""
    out = []
    for j, f in enumerate(others):
        column = np.empty(len(cells), object)
        column[:] = [c[j] for c in cells]
        out.append(np.array([np.nan if _missing(v) else float(v) for v in column]) if f in numeric else column)
    return out


def _cells(frame: pd.DataFrame, by: Sequence[str]) -> list[tuple[tuple, np.ndarray]]:
    """Values of `by` and the places of their rows, nulls as a value of their own."""
    if not by:
        return [((), np.arange(len(frame)))] if len(frame) else []
    codes = np.stack([pd.factorize(frame[f])[0] for f in by], axis=1)
    _, first, cell = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(cell.ravel(), kind="stable")
    ends = np.flatnonzero(np.diff(cell.ravel()[order], prepend=-1, append=len(first)))
    values = [frame[f].to_numpy(object) for f in by]
    return [(tuple(None if _missing(v[at]) else v[at] for v in values), order[x:y]) for at, x, y in zip(first, ends, ends[1:])]


class _Nearest:
    """A block's cases by cell, sorted by the number, for the k best of each query.

    In a cell a similarity depends on the difference of the numbers alone, so that the best are around the query's own
    number; of cases with the same features only the k + 1 smallest keys can be among the best. Cells are taken from the
    one with the highest bound down, until the bound of the next is below what a query has."""

    def __init__(self, c: pd.DataFrame, key: str, numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], number: str, first_stage: str, k: int):
        self.features, self.numeric, self.weights, self.number, self.key, self.k = [*numeric, *categorical], numeric, weights, number, key, k
        self.others = [f for f in self.features if f != number]
        self.cells = []
        for first in (True, False):
            rows = np.flatnonzero(c[first_stage].fillna(False).to_numpy(bool) == first)
            part = c.iloc[rows]
            x, ids = part[number].to_numpy(float), part[key].to_numpy()
            for cell, at in _cells(part, self.others):
                at = at[np.lexsort((ids[at], x[at]))]
                new = np.flatnonzero(np.append(True, (np.diff(x[at]) != 0) & ~(np.isnan(x[at][1:]) & np.isnan(x[at][:-1]))))
                at = at[np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))) <= k]
                known = int((~np.isnan(x[at])).sum())
                for some in (at[:known], at[known:]):  # cases without the number are all alike
                    if len(some):
                        self.cells.append((first, cell, x[some], ids[some], rows[some]))
        self.columns = _columns([c[1] for c in self.cells], self.others, numeric)
        self.first, self.unnumbered = np.array([c[0] for c in self.cells], bool), np.array([np.isnan(c[2][0]) for c in self.cells], bool)

    def _around(self, q: np.ndarray, own: np.ndarray, cell: tuple, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, similarities and places in the cell of each query's k best cases of it."""
        _, _, x, ids, _ = cell
        out, width, asked = [], 2 * (self.k + 1), np.arange(len(q))
        while len(asked):
            left_over = []
            for some in np.array_split(asked, max(1, len(asked) * 2 * min(width, len(x)) // 2_000_000)):
                if not len(some):
                    continue
                if len(x) <= 2 * width:
                    places, whole = np.broadcast_to(np.arange(len(x)), (len(some), len(x))), True
                else:
                    start = np.clip(np.searchsorted(x, q[some]) - width, 0, len(x) - 2 * width)
                    places, whole = start[:, None] + np.arange(2 * width), False
                sims = _pairs(q[some][:, None], x[places], parts, self.numeric, self.weights, self.number)
                sims = np.where(ids[places] == own[some][:, None], -np.inf, sims)
                done = np.ones(len(some), bool)
                if not whole:  # the next case outside must be worse than the k-th inside
                    kth = -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1]
                    low, high = np.maximum(places[:, 0] - 1, 0), np.minimum(places[:, -1] + 1, len(x) - 1)
                    far = lambda at: _pairs(q[some], x[at], parts, self.numeric, self.weights, self.number)
                    done = ((places[:, 0] == 0) | (far(low) < kth)) & ((places[:, -1] == len(x) - 1) | (far(high) < kth))
                    left_over.append(some[~done])
                if done.any():
                    at, col = _first_k_of(sims[done], ids[places[done]], self.k)
                    out.append((some[done][at], sims[done][at, col], places[done][at, col]))
            asked, width = np.concatenate(left_over) if left_over else np.array([], int), 2 * width
        if not out:
            return np.array([], int), np.array([]), np.array([], int)
        return tuple(np.concatenate(z) for z in zip(*out))

    def best(self, q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, rows of the block and similarities: each query's k best, and its k best of the first stage."""
        out = []
        for values, rows in _cells(q, self.others):
            x, own = q[self.number].to_numpy(float)[rows], q[self.key].to_numpy()[rows]
            every = _parts_of(values, self.columns, self.features, self.numeric, self.number)
            same, without = (np.broadcast_to(_pairs(np.float64(v), np.float64(0), every, self.numeric, self.weights, self.number), len(self.cells)) for v in (0, np.nan))
            numbered = np.where(self.unnumbered, without, same)
            unknown = np.isnan(x)
            most = np.where(unknown.any(), np.maximum(numbered, without), numbered)
            tops = {stage: np.full((len(rows), self.k), -np.inf) for stage in (True, False)}
            for j in np.argsort(-most, kind="stable"):
                if most[j] < tops[False][:, -1].min() and most[j] < tops[True][:, -1].min():
                    break
                cell = self.cells[j]
                bound = np.where(unknown, without[j], numbered[j])
                due = bound >= tops[False][:, -1]
                if cell[0]:
                    due |= bound >= tops[True][:, -1]
                asked = np.flatnonzero(due)
                if not len(asked):
                    continue
                parts = [(f, 0.0, True) if f == self.number else (f, d[j], known[j]) for f, d, known in every]
                at, sims, places = self._around(x[asked], own[asked], cell, parts)
                at = asked[at]
                out.append((rows[at], cell[4][places], sims))
                order = np.argsort(at, kind="stable")
                at, sims = at[order], sims[order]
                first = np.searchsorted(at, at)
                for stage in (True, False) if cell[0] else (False,):
                    found = np.full((len(rows), self.k), -np.inf)
                    found[at, np.arange(len(at)) - first] = sims
                    tops[stage] = -np.sort(-np.concatenate([tops[stage], found], axis=1), axis=1)[:, : self.k]
        if not out:
            return np.array([], int), np.array([], int), np.array([])
        return tuple(np.concatenate(z) for z in zip(*out))


def _first_k_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest values over minus infinity, the smaller of its ids first among equal ones."""
    least = -np.partition(-sims, k - 1, axis=1)[:, [k - 1]] if sims.shape[1] > k else -np.inf
    rows, cols = np.nonzero((sims >= least) & (sims > -np.inf))
    order = np.lexsort((ids[rows, cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept]


def _in_blocks(queries: DataFrame, cases: DataFrame, key: str, query_block: int, case_block: int):
    """Every block of queries together with every block of cases; blocks are even whatever the rows hold."""
    # queries are often a part of the cases: columns get identities of their own
    queries = queries.select(*[F.col(x).alias(x) for x in queries.columns])
    cases = cases.where(F.col(key).isNotNull()).select(*[F.col(x).alias(x) for x in cases.columns])
    n_q, n_c = max(1, -(-queries.count() // query_block)), max(1, -(-cases.count() // case_block))
    even = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("q_block", even(n_q)).withColumn("c_block", every(n_c))
    c = cases.withColumn("c_block", even(n_c)).withColumn("q_block", every(n_q))
    return q.groupBy("q_block", "c_block").cogroup(c.groupBy("q_block", "c_block"))


def _case_blocks(cases: DataFrame, key: str, number: str, size: int) -> tuple[DataFrame, pd.DataFrame]:
    """cases with block, and the blocks' lowest and highest number, in order. Blocks are ranges of number and key, so they are
    about even however many numbers are equal; one that holds cases without the number has no bounds. The bounds, a row
    for about `size` cases, come to the driver."""
    known = written(cases.where(F.col(key).isNotNull()), "cases")
    ranged = known.repartitionByRange(max(1, -(-known.count() // size)), number, key)
    placed = written(ranged.withColumn("block", F.spark_partition_id()), "case_blocks")
    loose = F.count_if(F.col(number).isNull()) > 0
    bounds = placed.groupBy("block").agg(F.when(~loose, F.min(number)).alias("low"), F.when(~loose, F.max(number)).alias("high"))
    return placed, bounds.toPandas().sort_values("block", ignore_index=True)


def best_cases(queries: DataFrame, cases: DataFrame, key: str, numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], first_stage: str, value: str, k: int = 5, query_block: int = 16384, case_block: int = 65536) -> DataFrame:
    """query, case_id, sim, first_stage, value: a stated query set against all cases but the query itself.

    Cases lie in even blocks by the number with the greatest weight. A query first meets the block in which its number
    falls; its k-th similarities there, of all cases and of the first stage's, against the best that the other features of any
    such case allow, tell how far away a better case can be, and it goes on to the blocks within that reach alone. Of
    each block it keeps its k best, and its k best of the first stage, and maybe more, so that these are among the rows, and k
    cases over any threshold of the first stage if there are so many. Queries or cases without the number meet every block.
    """
    number = max(numeric, key=lambda f: weights[f])
    total = sum(weights[f] for f in (*numeric, *categorical))
    placed, bounds = _case_blocks(cases, key, number, case_block)
    bounded = bounds[bounds["low"].notna()]
    loose = bounds.loc[bounds["low"].isna(), "block"].tolist()
    features = [*numeric, *categorical]
    fewer = [f for f in features if f != number]
    kinds_of = placed.where(F.col(number).isNotNull()).select(*fewer, F.coalesce(first_stage, F.lit(False)).alias("first__")).distinct().limit(MOST_CELLS + 1).toPandas()
    columns = _columns([tuple(r) for r in kinds_of[fewer].itertuples(index=False)], fewer, numeric) if len(kinds_of) <= MOST_CELLS else None
    first_kinds = kinds_of["first__"].to_numpy(bool)
    blocks, low, high = bounded["block"].to_numpy(), bounded["low"].to_numpy(float), bounded["high"].to_numpy(float)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows, cols, sims = _Nearest(c, key, numeric, categorical, weights, number, first_stage, k).best(q) if len(q) and len(c) else ([], [], [])
        found = c.iloc[cols]
        return pd.DataFrame({"query": q[key].to_numpy()[rows], "case_id": found[key].to_numpy(), "sim": sims, first_stage: found[first_stage].to_numpy(), value: found[value].to_numpy()})

    kinds = {f.name: f.dataType.simpleString() for f in cases.schema}
    schema = f"query {kinds[key]}, case_id {kinds[key]}, sim double, {first_stage} {kinds[first_stage]}, {value} {kinds[value]}"
    if not len(bounds):
        return queries.sparkSession.createDataFrame([], schema)

    @F.pandas_udf("int")
    def own(x: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(high, x.to_numpy(float)), max(0, len(high) - 1))
        return pd.Series(np.where(x.isna().to_numpy() | (len(blocks) == 0), bounds["block"].iloc[0], blocks[at] if len(blocks) else 0))

    @F.pandas_udf("array<int>")
    def others(x: pd.Series, floor: pd.Series, floor_first: pd.Series, home: pd.Series, rest: pd.DataFrame) -> pd.Series:
        best, best_first = np.ones(len(x)), np.ones(len(x))
        for values, rows in _cells(rest, fewer) if columns is not None and len(kinds_of) else ():
            most = np.broadcast_to(_pairs(np.float64(0), np.float64(0), _parts_of(values, columns, features, numeric, number), numeric, weights, number), len(kinds_of))
            best[rows], best_first[rows] = most.max(), most[first_kinds].max(initial=-np.inf)
        # similarities are rounded to 9 places
        lost = np.maximum(best - floor.to_numpy(float), best_first - floor_first.to_numpy(float)) + 2e-9
        reach = lost * total / weights[number] * max(numeric[number], 1e-6)
        reach = np.where(reach >= max(numeric[number], 1e-6), np.inf, reach)
        # a query that has not found k of each goes everywhere
        everywhere = np.isnan(x.to_numpy(float)) | floor.isna().to_numpy() | floor_first.isna().to_numpy()
        start = np.where(everywhere, 0, np.searchsorted(high, x.to_numpy(float) - reach))
        stop = np.where(everywhere, len(blocks), np.searchsorted(low, x.to_numpy(float) + reach, "right"))
        return pd.Series([[b for b in (*loose, *blocks[i:j].tolist()) if b != own_block] for i, j, own_block in zip(start, stop, home)])

    def meet(asked: DataFrame, fields: list[str]) -> DataFrame:
        """asked, with block, against their blocks' cases; the queries of a block come in parts."""
        # a task a block: a few megabytes of cases are work enough, which adaptive merging of small partitions cannot know
        tasks = max(len(bounds), asked.sparkSession.sparkContext.defaultParallelism)
        wide = asked.withColumn("part", F.pmod(F.xxhash64(key), F.count(F.lit(1)).over(W.partitionBy("block")).cast("long") / F.lit(query_block) + 1).cast("int"))
        wide = written(wide.select(*fields, "block", "part"), "asked")
        parts = wide.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
        met = placed.join(parts, "block").repartition(tasks, "block", "part").groupBy("block", "part")
        return wide.repartition(tasks, "block", "part").groupBy("block", "part").cogroup(met).applyInPandas(lambda q, c: run(q.reset_index(drop=True), c.reset_index(drop=True)), schema)

    # queries are often a part of the cases: columns get identities of their own
    fields = list(dict.fromkeys([key, *numeric, *categorical]))
    asked = written(queries.select(*[F.col(x).alias(x) for x in fields]).withColumn("block", own(F.col(number).cast("double"))), "queries")
    near = written(meet(asked, fields), "near")
    places = near.withColumns({"r": F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"))), "r1": F.when(F.col(first_stage), F.row_number().over(W.partitionBy("query", F.coalesce(first_stage, F.lit(False))).orderBy(F.desc("sim"))))})
    floors = places.groupBy(F.col("query").alias("asked")).agg(F.max(F.when(F.col("r") == k, F.col("sim"))).alias("all"), F.max(F.when(F.col("r1") == k, F.col("sim"))).alias("first"))
    further = asked.join(floors, F.col(key) == F.col("asked"), "left").withColumn("block", F.explode(others(F.col(number).cast("double"), "all", "first", "block", F.struct(*fewer, F.lit(0).alias("rest__")))))
    return near.unionByName(meet(further, fields))


class _Counts:
    """A block's cases, which stand for `n` cases each, by cell and sorted by the number, with running sums: how many reach
    `least` of similarity to a query, and the sum of these similarities. What reaches it in a cell lies within one
    distance of the query's number, which two searches find; similarities are rounded to 9 places when they meet `least`."""

    def __init__(self, c: pd.DataFrame, numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], number: str):
        self.features, self.numeric, self.weights, self.number = [*numeric, *categorical], numeric, weights, number
        self.others, self.cells = [f for f in self.features if f != number], []
        x, n = c[number].to_numpy(float), c["n"].to_numpy(float)
        found = _cells(c, self.others)
        self.columns = _columns([cell for cell, _ in found], self.others, numeric)
        for _, at in found:
            at = at[np.argsort(x[at], kind="stable")]
            known = at[~np.isnan(x[at])]
            middle = x[known].mean() if len(known) else 0.0
            sums = [np.append(0.0, np.cumsum(v)) for v in (n[known], n[known] * (x[known] - middle))]
            self.cells.append((x[known], middle, sums, n[at[len(known) :]].sum()))

    def over(self, q: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
        n, total = np.zeros(len(q)), np.zeros(len(q))
        span, w, lowest = max(self.numeric[self.number], 1e-6), self.weights[self.number], least - 5e-10
        for values, rows in _cells(q, self.others):
            x = q[self.number].to_numpy(float)[rows]
            order = np.argsort(x, kind="stable")  # NaN last
            rows, x = rows[order], x[order]
            numbers = int((~np.isnan(x)).sum())
            every = _parts_of(values, self.columns, self.features, self.numeric, self.number)
            # the other features' parts and weights by cell
            apart = sum((np.where(k, self.weights[f] * d, 0.0) for f, d, k in every if f != self.number), np.zeros(len(self.cells)))
            weight = sum((np.where(k, self.weights[f], 0.0) for f, d, k in every if f != self.number), np.zeros(len(self.cells)))
            for (xs, middle, (ns, sums), unnumbered), t, rest in zip(self.cells, apart, weight, strict=True):
                without = round(1 - (t / rest if rest > 0 else 1.0), 9)
                if without >= least:  # where a side has no number
                    alone = np.where(np.arange(len(x)) < numbers, unnumbered, unnumbered + ns[-1])
                    n[rows] += alone
                    total[rows] += alone * without
                room = (rest + w) * (1 - lowest) - t
                if room < 0 or not len(xs) or not numbers:
                    continue
                at, here = rows[:numbers], x[:numbers]
                near = np.minimum(room / w, 1.0) * span
                low, mid, high = np.searchsorted(xs, here - near), np.searchsorted(xs, here), np.searchsorted(xs, here + near, "right")
                inside = ns[high] - ns[low]
                far = (sums[high] - sums[mid]) - (here - middle) * (ns[high] - ns[mid]) + (here - middle) * (ns[mid] - ns[low]) - (sums[mid] - sums[low])
                n[at] += inside
                total[at] += inside * (1 - t / (rest + w)) - far * (w / (rest + w) / span)
                if room >= w:  # however far away
                    n[at] += ns[-1] - inside
                    total[at] += (ns[-1] - inside) * (1 - (t + w) / (rest + w))
        return n, total


def similar_counts(queries: DataFrame, cases: DataFrame, key: str, numeric: Mapping[str, float], categorical: Sequence[str], weights: Mapping[str, float], least: float, query_block: int = 65_536, case_block: int = 2_000_000) -> DataFrame:
    """query, n, mean_sim: how many of all cases but the query itself reach `least`, and their mean similarity,
    for queries that have any.

    Cases with the same features are counted first. A query meets every block of them, but within a block it asks each cell of
    the other features for two places in the order of the number, not each case. Similarities enter the mean as they are
    before they are rounded. Cases of the query's own key are taken off again."""
    number = max(numeric, key=lambda f: weights[f])
    features = [*numeric, *categorical]
    known = cases.where(F.col(key).isNotNull())
    alike = written(known.groupBy(*features).agg(F.count(F.lit(1)).alias("n")), "alike")
    asked = written(queries.select(*[F.col(x).alias(x) for x in dict.fromkeys([key, *features])]), "asked")
    n_q, n_c = max(1, -(-asked.count() // query_block)), max(1, -(-alike.count() // case_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    even = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    q = asked.withColumn("q_block", even(n_q, key)).withColumn("c_block", every(n_c))
    c = alike.withColumn("c_block", even(n_c, *features)).withColumn("q_block", every(n_q))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        n, total = _Counts(c, numeric, categorical, weights, number).over(q, least)
        return pd.DataFrame({"query": q[key].to_numpy(), "n": n.astype(np.int64), "total": total})

    schema = f"query {cases.schema[key].dataType.simpleString()}, n long, total double"
    tasks = n_q * n_c
    dealt = [side.repartition(tasks, "q_block", "c_block").groupBy("q_block", "c_block") for side in (q, c)]
    counts = dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)
    # the query itself, which the blocks count with the rest
    sides = [side.select(F.col(key).alias(name), F.struct(*[F.col(f).alias(f) for f in features]).alias(side_name)) for side, name, side_name in ((asked, "query", "q"), (known, "case__", "c"))]
    itself = sides[0].join(sides[1], F.col("query") == F.col("case__")).select("query", F.round(1 - gower(numeric, categorical, weights), 9).alias("sim")).where(F.col("sim") >= least)
    both = counts.unionByName(itself.select("query", F.lit(-1).cast("long").alias("n"), (-F.col("sim")).alias("total")))
    return both.groupBy("query").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").select("query", "n", (F.col("total") / F.col("n")).alias("mean_sim"))


def two_stage(scored: DataFrame, query: str, case: str, sim: str, first_stage: str, k: int = 5, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """The k best of the first stage's cases where at least `least` of them reach the threshold, else of all."""
    good = F.sum((F.col(first_stage) & (F.col(sim) >= threshold)).cast("int")).over(W.partitionBy(query))
    staged = scored.withColumn("stage", F.when(good >= least, 1).otherwise(2)).where((F.col("stage") == 2) | F.col(first_stage))
    return staged.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(sim), case))).where(F.col("rank") <= k)


def predict(top: DataFrame, query: str, sim: str, value: str, k0: int = 3, least_eff: float = 3.0, least_confidence: float = 0.4) -> DataFrame:
    """For each query the similarity-weighted mean and step median of its cases, the effective sample size,
    a confidence and whether to abstain."""
    order = W.partitionBy(query).orderBy(value, sim)
    total = F.sum(sim).over(W.partitionBy(query))
    cum = F.sum(sim).over(order.rowsBetween(W.unboundedPreceding, 0))
    w = top.withColumn("share", cum / total)
    n_eff = F.sum(sim) * F.sum(sim) / F.sum(F.col(sim) * F.col(sim))
    out = w.groupBy(query).agg(
        F.count(F.lit(1)).alias("n"),
        n_eff.alias("n_eff"),
        (F.sum(F.col(sim) * F.col(value)) / F.sum(sim)).alias("weighted_mean"),
        F.min(F.when(F.col("share") >= 0.5 - 1e-9, F.col(value))).alias("weighted_median"),
        (F.least(F.lit(1.0), F.count(F.lit(1)) / k0) * F.avg(sim)).alias("confidence"),
        F.max(sim).alias("best"),
    )
    return out.withColumn("abstain", (F.col("n_eff") < least_eff) | (F.col("confidence") < least_confidence))


def cosine_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, query_block: int = 16_384, block: int = 16_384) -> DataFrame:
    """query, key, cosine, rank: a stated query set against all vectors, by cosines to 6 places, of equal ones the smaller key
    first; a vector of zeros has none and comes last.

    Every block of queries meets every block of vectors as two matrices, whose product holds the cosines; only the k best of
    a query in a block leave it."""
    sides = [df.select(F.col(key).alias(name), F.col(vector).alias(of)) for df, name, of in ((queries, "query", "qv"), (vectors, key, "v"))]
    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in zip(sides, (query_block, block), strict=True))
    even = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = sides[0].withColumn("q_block", even("query", n_q)).withColumn("v_block", every(n_v))
    v = sides[1].where(F.col(key).isNotNull()).withColumn("v_block", even(key, n_v)).withColumn("q_block", every(n_q))
    kind = vectors.schema[key].dataType.simpleString()

    def unit(column: pd.Series, width: int) -> np.ndarray:
        """Vectors of length 1 as rows; NaN where there is none, its length differs or is 0."""
        fits = np.array([x is not None and len(x) == width for x in column], bool)
        out = np.full((len(column), width), np.nan)
        if fits.any():
            out[fits] = np.stack(column[fits].to_list())
        with np.errstate(divide="ignore", invalid="ignore"):
            return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            width = max((len(x) for side in (q["qv"], v["v"]) for x in side if x is not None), default=0)
            b, ids = unit(v["v"], width).T, v[key].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                cosines = np.round(unit(part["qv"], width) @ b, 6) + 0.0
                # what has no cosine comes after all that have one, but not the query itself
                sims = np.where(np.isnan(cosines), -9.0, cosines)
                sims = np.where(part["query"].to_numpy()[:, None] == ids, -np.inf, sims)
                rows, cols = _first_k(sims, ids, k)
                found = cosines[rows, cols]
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[rows], key: ids[cols], "cosine": pd.Series(found).astype(object).where(~np.isnan(found), None)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], key: [], "cosine": []})

    dealt = [side.repartition(n_q * n_v, "q_block", "v_block").groupBy("q_block", "v_block") for side in (q, v)]
    best = dealt[0].cogroup(dealt[1]).applyInPandas(run, f"query {kind}, {key} {kind}, cosine double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= k).select("query", key, "cosine", "rank")
