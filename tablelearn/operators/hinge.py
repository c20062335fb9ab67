"""Linear support vector machines, many at once, by a primal-dual interior-point method.

Each problem is min 1/2 ||w||^2 + C sum max(0, 1 - y (w.x + b)) over the rows
whose label is 1 or -1 in it; all problems share a table of mapped rows.  An
iteration has two passes: one sums the matrix of the Newton system, the other
finds the longest step that keeps every row's variables positive.

The rows are packed once, in records of rows that are in the same problems, so
a pass computes nothing for problems that a row isn't in.  A record holds the
rows before ``mapped``, if that is given: making a wide row anew in each pass is
cheaper than moving it there.

The variables of a row (its multiplier and its two slacks) are written with the
records every ``SAVE`` steps; a pass gets the steps made since, and the rows
replay them.  With one task they are never written.

A pass sends one sum of half the symmetric matrices to the driver, however many
tasks made parts of it.

Every problem ends with its duality gap, a bound on how far its objective is
from the optimum.  The driver holds a width x width matrix for each problem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import matrix
from ..session import cut_lineage, ship_package

CHUNK = 2048               # rows that a kernel holds at once
SAVE = 8                   # steps that rows replay at most, if there are several tasks
RECORD = "cols binary, x binary, y binary, state binary"
PIECE = 1 << 13            # numbers in a row of a sum
FEW_TASKS = 16             # partial sums that one task adds to a whole one


@dataclass
class Plane:
    w: np.ndarray
    b: float
    objective: float
    gap: float
    n_iter: int


def _move(a, xi, t, y, C, df, mu):
    """The Newton direction of the rows' variables, given that of the margins."""
    ra, rb = 1 / a, 1 / (C - a)
    da = (mu * (ra - rb) + xi - t - y * df) / (xi * rb + t * ra)
    return da, rb * (mu + xi * da) - xi, ra * (mu - t * da) - t


def _replay(z, y, C, state, steps):
    """Multipliers and slacks (rows x problems) after the steps."""
    a, xi, t = state if state is not None else (np.tile(C / 2, (len(z), 1)), np.full(y.shape, 2.0), np.ones(y.shape))
    for dv, s, mu in steps:
        da, dx, dt = _move(a, xi, t, y, C, z @ dv.T, mu)
        a, xi, t = a + s * da, xi + s * dx, t + s * dt
    return a, xi, t


def _alike(y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of rows that are in the same problems, and these; rows in none are left out."""
    bits = np.packbits(y != 0, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
    kinds, kind = np.unique(bits[:, 0] if bits.shape[1] == 1 else bits, axis=0, return_inverse=True)
    for k in range(len(kinds)):
        rows = np.flatnonzero(kind.ravel() == k)
        cols = np.flatnonzero(y[rows[0]])
        if len(cols):
            yield rows, cols


def _record(cols, x, y, state=None) -> pa.RecordBatch:
    held = [cols.astype(np.int32).tobytes(), x.tobytes(), y.astype(np.int8).tobytes(),
            None if state is None else np.stack(state).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([h], pa.binary()) for h in held], names=["cols", "x", "y", "state"])


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """Rows and labels to records of ``CHUNK`` rows; less for the last ones of each kind."""
    waiting = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = matrix(batch.column(0)), matrix(batch.column(1))
        for rows, cols in _alike(y):
            kind = cols.tobytes()
            held = waiting.setdefault(kind, [])
            held.append((x[rows], y[np.ix_(rows, cols)]))
            if sum(len(h[0]) for h in held) >= CHUNK:
                xs, ys = (np.concatenate(h) for h in zip(*held))
                whole = len(xs) // CHUNK * CHUNK
                for lo in range(0, whole, CHUNK):
                    yield _record(cols, xs[lo:lo + CHUNK], ys[lo:lo + CHUNK])
                waiting[kind] = [(xs[whole:], ys[whole:])]
    for kind, held in waiting.items():
        xs, ys = (np.concatenate(h) for h in zip(*held))
        if len(xs):
            yield _record(np.frombuffer(kind, np.int64), xs, ys)


def _chunks(batches, live, mapped: Callable | None):
    """Rows of records: before and after the map, labels, state, the problems they are in, and their places in ``live``."""
    for batch in batches:
        for record in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
            packed = [record] if "cols" in record.schema.names else _pack([record])
            for part in packed:
                for cols, x, y, state in zip(*[c.to_pylist() for c in part.columns]):
                    cols = np.frombuffer(cols, np.int32)
                    keep = np.flatnonzero(np.isin(cols, live))
                    if not len(keep):
                        continue
                    y = np.frombuffer(y, np.int8).reshape(-1, len(cols))
                    x = np.frombuffer(x).reshape(len(y), -1)
                    if state is not None:
                        state = np.frombuffer(state).reshape(3, len(y), len(cols))[:, :, keep]
                    z = mapped(x) if mapped else x
                    yield (x, np.hstack([z, np.ones((len(z), 1))]), y[:, keep].astype(float), state, cols[keep],
                           np.searchsorted(live, cols[keep]))


def _of(steps, at):
    return [(dv[at], s[at], mu[at]) for dv, s, mu in steps]


def _save(data: DataFrame, C, live, steps, mapped: Callable | None) -> DataFrame:
    """The records of live problems with the state after the steps."""
    def run(batches):
        for x, z, y, state, cols, at in _chunks(batches, live, mapped):
            yield _record(cols, x, y, _replay(z, y, C[at], state, _of(steps, at)))

    return cut_lineage(data.mapInArrow(run, RECORD)).persist()


def _sums(data: DataFrame, C, live, steps, width: int, tasks: int, base=None,
          mapped: Callable | None = None) -> np.ndarray:
    """For each live problem: matrix, three vectors, then gap, loss, multipliers, rows and gaps in rows.

    ``data`` are records, or rows and labels; ``steps`` are those since ``base``, the planes when the state was saved.
    """
    q = width + 1
    upper = np.triu_indices(q)                       # the matrices are symmetric
    half = len(upper[0])
    size = half + 3 * q + 5
    v = sum((s[:, None] * dv for dv, s, _ in steps), np.zeros((len(live), q)) if base is None else base)

    def run(batches):
        total, whole = np.zeros((len(live), size)), np.zeros((len(live), q, q))
        for _, z, y, state, _, at in _chunks(batches, live, mapped):
            bound = C[at]
            a, xi, t = _replay(z, y, bound, state, _of(steps, at))
            b = bound - a
            weight = 1 / (xi / b + t / a)
            for i, w in zip(at, weight.T):
                part = z * np.sqrt(w)[:, None]
                whole[i] += part.T @ part
            total[at, half:-5] += np.hstack([(z.T @ c).T for c in (
                a * y, y * (1 / a - 1 / b) * weight, y * (xi - t) * weight)])
            scalars = (a * t + b * xi, bound * np.maximum(0, 1 - y * (z @ v[at].T)), a, np.ones_like(a),
                       np.broadcast_to(np.isnan(z).any(axis=1)[:, None], a.shape))
            total[at, -5:] += np.stack([c.sum(axis=0) for c in scalars], axis=1)
        total[:, :half] = whole[:, upper[0], upper[1]]
        flat = total.ravel()
        ends = range(0, len(flat), PIECE)
        task = TaskContext.get().partitionId() % FEW_TASKS
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(ends), dtype=np.int32)), pa.array(np.full(len(ends), task, np.int32)),
            pa.array([flat[e:e + PIECE].tobytes() for e in ends], pa.binary())], names=["i", "task", "s"])

    def add(pdf):
        return pdf.head(1).assign(s=[np.sum([np.frombuffer(s) for s in pdf["s"]], axis=0).tobytes()])

    parts = data.mapInArrow(run, "i int, task int, s binary")
    if tasks > FEW_TASKS:
        parts = parts.groupBy("i", "task").applyInPandas(add, parts.schema)
    if tasks > 1:
        parts = parts.groupBy("i").applyInPandas(add, parts.schema)
    flat = np.zeros(len(live) * size)
    for r in parts.collect():               # the size of the sums, whatever the number of tasks
        flat[r["i"] * PIECE:(r["i"] + 1) * PIECE] += np.frombuffer(r["s"])
    flat = flat.reshape(len(live), size)
    whole = np.zeros((len(live), q, q))
    whole[:, upper[0], upper[1]] = flat[:, :half]
    whole[:, upper[1], upper[0]] = flat[:, :half]
    return np.hstack([whole.reshape(len(live), q * q), flat[:, half:]])


def _reach(data: DataFrame, C, live, steps, dv, mu, mapped: Callable | None = None) -> np.ndarray:
    """The longest step of each live problem."""
    def run(batches):
        least = np.full(len(live), np.inf)
        for _, z, y, state, _, at in _chunks(batches, live, mapped):
            bound = C[at]
            a, xi, t = _replay(z, y, bound, state, _of(steps, at))
            da, dx, dt = _move(a, xi, t, y, bound, z @ dv[at].T, mu[at])
            falls = np.maximum.reduce([-da / a, da / (bound - a), -dx / xi, -dt / t]).max(axis=0)
            least[at] = np.minimum(least[at], np.where(falls > 0, 1 / np.where(falls > 0, falls, 1.0), np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(live), dtype=np.int32)), pa.array(least)],
                                         names=["i", "s"])

    found = data.mapInArrow(run, "i int, s double").groupBy("i").agg(F.min("s").alias("s")).collect()
    return np.array([s for _, s in sorted(map(tuple, found))])


def solve(data: DataFrame, C: Sequence[float], width: int, tasks: int, tol: float = 1e-11,
          max_iter: int = 60, mapped: Callable | None = None) -> list[Plane]:
    """A plane for each problem.

    ``data`` has two columns: the row (array of ``width``, or what ``mapped``
    makes rows of ``width`` of, a block at a time) and its
    labels (1, -1 or 0 for each problem).  A problem ends when its duality gap
    is below ``tol`` times its objective, or can't be lowered any more.
    """
    ship_package(data.sparkSession)
    C, q = np.asarray(C, float), width + 1
    ridge = np.eye(q)
    ridge[-1, -1] = 0.0
    v, last, steps, out = np.zeros((len(C), q)), np.zeros(len(C)), [], {}
    live, base = np.arange(len(C)), v
    data = data.mapInArrow(_pack, RECORD).persist()
    for it in range(max_iter + 1):
        sums = _sums(data, C[live], live, _of(steps, live), width, tasks, base[live], mapped)
        dv, mu, s = np.zeros((len(C), q)), np.ones(len(C)), np.zeros(len(C))
        for i, row in zip(live, sums, strict=True):
            m, (u, centre, rest) = row[:q * q].reshape(q, q), row[q * q:-5].reshape(3, q)
            comp, loss, multipliers, n, bad = row[-5:]
            if bad:
                raise ValueError(f"{int(bad)} rows have a missing feature; impute or drop them first")
            objective = 0.5 * v[i, :-1] @ v[i, :-1] + loss
            gap = objective - (multipliers - 0.5 * u[:-1] @ u[:-1])
            done = comp <= tol * (1 + objective) and np.abs(ridge @ v[i] - u).max() <= 1e-7 * (1 + C[i] * n)
            stuck = it > 0 and not 1e-6 < last[i]
            if not n or done or stuck or it == max_iter:
                out[i] = Plane(v[i, :-1].copy(), float(v[i, -1]), float(objective), float(gap), it)
                continue
            mu[i] = comp / (2 * n) * (0.03 if last[i] > 0.9 else 0.1 if last[i] > 0.5 else 0.5)
            dv[i] = np.linalg.lstsq(m + ridge, u - ridge @ v[i] + mu[i] * centre + rest, rcond=None)[0]
        left = np.array([i for i in live if i not in out], int)
        if not len(left):
            break
        live = left
        s[live] = np.minimum(1.0, 0.99 * _reach(data, C[live], live, _of(steps, live), dv[live], mu[live], mapped))
        v, last = v + s[:, None] * dv, s
        steps.append((dv, s, mu))
        if tasks > 1 and len(steps) == SAVE:
            saved = _save(data, C[live], live, _of(steps, live), mapped)
            data.unpersist()
            data, steps, base = saved, [], v
    data.unpersist()
    return [out[i] for i in range(len(C))]
