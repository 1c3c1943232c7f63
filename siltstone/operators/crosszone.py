"""Activity that spreads between zones: a joint fit of base rates, self-excitation and excitation by other zones.

For a decay rate a zone's intensity is linear in its parameters, theta . x, where x holds 1, the kernel sum of the zone's own
past and one kernel sum for each zone that may excite it. Events of a zone that share a time share x. They are dealt by ranges
of time; a task finds the sums over its own range for all rates at once, and only what each zone carries from one range to the
next passes through the driver. The penalised likelihood is concave: each Newton step goes to the top of its quadratic model
within the bounds, so that few rounds are needed. A round is one pass over all events for all zones, rates and both models,
from which gradients and curvatures of a few numbers a zone return. Standard errors come from the curvature at the top.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.temporal import HOUR
from siltstone.sources.scratch import written

EDGES = "source_zone {0}, receiver_zone {0}, alpha double, se double, ci_low double, ci_high double, branching double, beta double, half_life_hours double, lr double, p_value double"


def chi2_tail(x: float, df: int) -> float:
    """The probability that a chi square with df degrees of freedom exceeds x."""
    if df <= 0 or x <= 0:
        return 1.0
    tail, k = (math.exp(-x / 2), 2) if df % 2 == 0 else (math.erfc(math.sqrt(x / 2)), 1)
    while k < df:
        tail += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        k += 2
    return min(1.0, tail)


def _before(h: np.ndarray, m: np.ndarray, start: float, beta: float) -> np.ndarray:
    """For each of some events in order of time the marks before it, decayed to it; start is that of the first.
    Blocks of time are so short that no exponent in them leaves the range of a double."""
    out = np.empty(len(h))
    block = np.floor((h - h[0]) * beta / 300.0)
    edges = np.flatnonzero(np.diff(block, prepend=-1.0, append=np.inf))
    for x, y in zip(edges, edges[1:]):
        into = (out[x - 1] + m[x - 1]) * np.exp(-beta * (h[x] - h[x - 1])) if x else start
        grows = np.exp(beta * (h[x:y] - h[x]))
        out[x:y] = np.cumsum(np.append(into, (m[x:y] * grows)[:-1])) / grows
    return out


LOCAL = "part int, zone int, first double, last double, total array<double>, h binary, n binary, x binary"


def _local_sums(listed: dict, betas: np.ndarray, places: int):
    """Cells of zone, time, mark and number of events in order of time: for each batch and zone the times, numbers and kernel
    sums (by rate and place in listed, the zones that excite it) over strictly earlier cells of the same part, and
    the zone's own sums right after its last cell."""

    def run(batches):
        import pyarrow as pa

        part, series = TaskContext.get().partitionId(), {}
        for batch in batches:
            zone, h, m, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            here = [int(z) for z in np.unique(zone)]
            # of earlier batches a zone's last event is enough, with the sums before it: the next may share its time
            series = {u: (hs[-1:], ms[-1:], sums[:, -1:]) for u, (hs, ms, sums) in series.items()}
            for u in here:
                hs, ms, start = h[zone == u], m[zone == u], np.zeros(len(betas))
                if u in series:
                    hs, ms, start = np.append(series[u][0], hs), np.append(series[u][1], ms), series[u][2][:, 0]
                series[u] = hs, ms, np.array([_before(hs, ms, s, b) for s, b in zip(start, betas)])
            out = []
            for v in here:
                at = h[zone == v]
                x = np.zeros((len(betas), places, len(at) if v in listed else 0))
                for k, u in enumerate(listed.get(v, [])):
                    if u in series:
                        hs, ms, sums = series[u]
                        i = np.searchsorted(hs, at) - 1
                        j = np.maximum(i, 0)
                        x[:, k] = np.where(i < 0, sums[:, :1], (sums[:, j] + ms[j]) * np.exp(-betas[:, None] * np.maximum(at - hs[j], 0.0)))
                hs, ms, sums = series[v]
                out.append((part, v, at[0], at[-1], sums[:, -1] + ms[-1], at.tobytes(), n[zone == v].astype(float).tobytes(), x.tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in LOCAL.split(", ")])

    return run


def _whole_sums(listed: dict, betas: np.ndarray, places: int, carried):
    """_local_sums' rows with what came in earlier parts added; carried holds by part its start and each zone's sums there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            part, zone, h, n, x = (batch.column(i) for i in range(5))
            out = []
            for i, v in enumerate(zone.to_pylist()):
                if v not in listed:
                    continue
                start, sums = carried.value[part[i].as_py()]
                decay = np.exp(-betas[:, None] * (np.frombuffer(h[i].as_buffer()) - start))
                whole = np.frombuffer(x[i].as_buffer()).reshape(len(betas), places, -1).copy()
                for k, u in enumerate(listed[v]):
                    if u in sums:
                        whole[:, k] += sums[u][:, None] * decay
                out.append(whole.tobytes())
            kept = pa.array([v in listed for v in zone.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([zone.filter(kept), n.filter(kept), pa.array(out, pa.binary())], names=["zone", "n", "x"])

    return run


def kernel_vectors(rows: DataFrame, listed: dict, t: str, mark: Column, betas: Sequence[float], low) -> DataFrame:
    """zone, n and x of the rows, whose zone is an int: blocks of events of a zone, as doubles: the number of events that share
    a time, and by rate and place in listed the marks of that zone's events before it, decayed to it.

    A task holds a batch and the last event of every zone, however many events share a time or however few zones there are.
    """
    spark, rates, places = rows.sparkSession, np.array(betas, float), max(len(us) for us in listed.values())
    cells = rows.groupBy("zone", F.col(t).alias("t")).agg(F.coalesce(F.sum(mark.cast("double")), F.lit(0.0)).alias("m"), F.count(F.lit(1)).alias("n"))
    ranged = cells.repartitionByRange("t").sortWithinPartitions("t").select("zone", ((F.col("t") - F.lit(low)) / float(HOUR)).alias("h"), "m", "n")
    local = written(ranged.mapInArrow(_local_sums(listed, rates, places), LOCAL), "cross_zone_local")
    end = F.max_by(F.struct("last", "total"), "last").alias("end")
    parts: dict = {}
    for r in local.groupBy("part", "zone").agg(F.min("first").alias("first"), end).collect():
        parts.setdefault(r["part"], []).append(r)
    state, carried = {}, {}
    for part, ends in sorted(parts.items(), key=lambda p: min(r["first"] for r in p[1])):
        start = min(r["first"] for r in ends)
        carried[part] = start, {u: total * np.exp(-rates * (start - at)) for u, (at, total) in state.items()}
        for r in ends:
            came = carried[part][1].get(r["zone"], 0.0) * np.exp(-rates * (r["end"]["last"] - start))
            state[r["zone"]] = r["end"]["last"], np.array(r["end"]["total"]) + came
    given = spark.sparkContext.broadcast(carried)
    return written(local.select("part", "zone", "h", "n", "x").mapInArrow(_whole_sums(listed, rates, places, given), "zone int, n binary, x binary"), "cross_zone")


def _sums(data: DataFrame, theta: dict, rates: int) -> dict:
    """By (rate, zone, model) the log-likelihood's sum of logs, gradient and curvature for parameters theta."""
    fits, size = list(theta), len(next(iter(theta.values())))
    of_zone: dict = {}
    for f, (i, v, _) in enumerate(fits):
        of_zone.setdefault(v, []).append((f, i, np.array(theta[fits[f]], float)))
    given = data.sparkSession.sparkContext.broadcast(of_zone)
    upper = np.triu_indices(size)
    names = ["fit", *[f"s{k}" for k in range(1 + size + len(upper[0]))]]

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            zone, n, x = (batch.column(k) for k in range(3))
            for k, v in enumerate(zone.to_pylist()):
                fitted = given.value.get(v, ())
                if not fitted:
                    continue
                count = np.frombuffer(n[k].as_buffer())
                own = np.frombuffer(x[k].as_buffer()).reshape(rates, size - 1, len(count))
                for f, i, th in fitted:
                    a = np.concatenate([np.ones((1, len(count))), own[i]])
                    r = np.maximum(1e-10, th @ a)
                    a /= r
                    part = np.concatenate([[count @ np.log(r)], a @ count, ((a * count) @ a.T)[upper]])
                    sums[f] = sums.get(f, 0.0) + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array(c) for c in np.array(list(sums.values())).T]], names=names)

    out = {}
    found = data.mapInArrow(run, ", ".join(["fit int", *[f"{c} double" for c in names[1:]]]))
    for f, *r in found.groupBy("fit").agg(*[F.sum(c) for c in names[1:]]).collect():
        curve = np.zeros((size, size))
        curve[upper] = r[1 + size :]
        out[fits[f]] = r[0], np.array(r[1 : 1 + size]), curve + np.triu(curve, 1).T
    return out


def bounded_step(h: np.ndarray, g: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The d with d >= -room that makes g . d - d . h . d / 2 largest, by growing the set of parameters off their bound."""
    scale = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))
    a = h * scale[:, None] * scale + 1e-10 * np.eye(len(g))
    at = room / scale
    b = g * scale + a @ at
    z, off = np.zeros(len(g)), np.zeros(len(g), bool)
    for _ in range(10 * len(g)):
        slope = np.where(off, -np.inf, b - a @ z)
        if off.all() or slope.max() <= 1e-12 * max(1.0, np.abs(b).max()):
            break
        off[slope.argmax()] = True
        while off.any():
            top = np.zeros(len(g))
            top[off] = np.linalg.solve(a[np.ix_(off, off)], b[off])
            under = off & (top <= 0)
            if not under.any():
                z = top
                break
            z = z + (top - z) * (z[under] / (z[under] - top[under])).min()
            off &= z > 1e-15 * max(1.0, np.abs(z).max())
            z[~off] = 0.0
    return (z - at) * scale


def _maximum(data: DataFrame, cost: dict, free: dict, start: dict, penalty: dict, rates: int, rounds: int, tolerance: float) -> dict:
    """theta, the unpenalised log-likelihood and its curvature by (rate, zone, model): Newton steps within bounds with
    backtracking, all fits side by side.

    cost is the compensator's coefficient of each parameter; only parameters in free move; none falls below 0."""
    size = len(next(iter(cost.values())))
    least = np.append(1e-8, np.zeros(size - 1))
    found: dict = {}
    trial, going, state = dict(start), dict.fromkeys(start), {}
    for _ in range(rounds):
        for k, (log, grad, curve) in _sums(data, {k: trial[k] for k in going}, rates).items():
            pen = penalty[k]
            score = log - cost[k] @ trial[k] - pen @ trial[k] ** 2
            if k in state and score < state[k][0] - 1e-9 * abs(state[k][0]):
                state[k][2] /= 4
                if state[k][2] < 1e-8:
                    going.pop(k)
                    continue
            else:
                found[k] = trial[k], log - cost[k] @ trial[k], curve
                g = grad - cost[k] - 2 * pen * trial[k]
                move, direction = free[k], np.zeros(size)
                direction[move] = bounded_step((curve + np.diag(2 * pen))[np.ix_(move, move)], g[move], (trial[k] - least)[move])
                if g @ direction < tolerance:
                    going.pop(k)
                    continue
                state[k] = [score, direction, 1.0]
            trial[k] = np.maximum(least, found[k][0] + state[k][2] * state[k][1])
        if not going:
            break
    return found


def fit_cross_zone(events: DataFrame, sources: dict, zone: str, t: str, mark: Column, *, betas: Sequence[float] = (0.05, 0.2, 0.8, 3.2), shrink: float = 0.5, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """One row for each zone's own excitation and for each of its sources: alpha with standard error and 95 % interval,
    branching ratio, the decay rate shared by all zones (that of the highest likelihood), its half life, and the likelihood
    ratio test of the zone's cross terms against self-excitation alone.

    sources lists, by zone, the zones that may excite it; zones without events have no rows. Cross terms are shrunk by
    shrink / events of the zone times their squares. Events without zone or time are left out.
    """
    spark, kind = events.sparkSession, events.schema[zone].dataType.simpleString()
    rows = events.where(F.col(zone).isNotNull() & F.col(t).isNotNull())
    span = rows.agg(F.min(t).alias("low"), F.max(t).alias("high")).first()
    if span["low"] is None:
        return spark.createDataFrame([], EDGES.format(kind))
    length = max((span["high"] - span["low"]) / HOUR, 1e-9)
    left = (F.lit(span["high"]) - F.col(t)) / float(HOUR)
    reach = [F.sum(mark * (1 - F.exp(-b * left))).alias(f"r{i}") for i, b in enumerate(betas)]
    found = {r[zone]: r for r in rows.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.avg(mark).alias("mean"), *reach).collect()}
    sources = {v: [u for u in us if u in found and u != v] for v, us in sources.items() if v in found}
    size = 2 + max((len(us) for us in sources.values()), default=0)
    if not sources:
        return spark.createDataFrame([], EDGES.format(kind))
    code = {u: i for i, u in enumerate(dict.fromkeys(z for v, us in sources.items() for z in [v, *us]))}
    codes = F.broadcast(spark.createDataFrame(list(code.items()), f"of_zone {kind}, code int"))
    coded = rows.join(codes, F.col(zone) == F.col("of_zone")).select(F.col("code").alias("zone"), F.col(t).alias("at"), mark.alias("m"))
    data = kernel_vectors(coded, {code[v]: [code[u] for u in [v, *us]] for v, us in sources.items()}, "at", F.col("m"), betas, span["low"])

    # each zone with and without its cross terms
    cost, free, start, penalty = {}, {}, {}, {}
    for i, b in enumerate(betas):
        for v, us in sources.items():
            c = np.zeros(size)
            c[0] = length
            for k, u in enumerate([v, *us]):
                c[k + 1] = found[u][f"r{i}"] / b
            begin = np.zeros(size)
            begin[0] = 0.5 * found[v]["n"] / length
            begin[1 : 2 + len(us)] = 0.5 * found[v]["n"] / np.maximum(c[1 : 2 + len(us)], 1e-9) / (1 + len(us))
            pen = np.zeros(size)
            pen[2:] = shrink / found[v]["n"]
            own = np.arange(size) < 2
            whole, alone = (i, code[v], True), (i, code[v], False)
            cost[whole], free[whole], start[whole], penalty[whole] = c, c > 0, begin, pen
            cost[alone], free[alone], start[alone], penalty[alone] = c, own & (c > 0), np.where(own, np.maximum(begin, 1e-8), 0.0), np.zeros(size)
    fits = _maximum(data, cost, free, start, penalty, len(betas), rounds, tolerance)
    best = max(range(len(betas)), key=lambda i: sum(fits[i, code[v], True][1] for v in sources))
    out, beta = [], float(betas[best])
    for v, us in sources.items():
        (theta, top, curve), alone = fits[best, code[v], True], fits[best, code[v], False][1]
        used = np.arange(size) < 2 + len(us)
        errors = np.zeros(size)
        errors[used] = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(curve[np.ix_(used, used)]))))
        lr = float(max(0.0, 2 * (top - alone)))
        for k, u in enumerate([v, *us]):
            a, se = float(theta[k + 1]), float(errors[k + 1])
            out.append((u, v, a, se, max(0.0, a - 1.96 * se), a + 1.96 * se, a / beta * float(found[u]["mean"]), beta, math.log(2) / beta, lr, chi2_tail(lr, len(us))))
    return spark.createDataFrame(out, EDGES.format(kind))
