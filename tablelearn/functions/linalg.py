"""Moment matrices: n, the means and the *centred* co-moments of columns.

Up to ``WIDE`` columns, one Spark aggregate of ``covar_pop`` (a stable one-pass
merge).  With more, an aggregate per pair would be thousands of them, so the
means come first and then products of centred Arrow batches, summed per task
and by a grouped aggregate over the matrix's places.  Both skip a pair of
columns in rows where either is null.  The result is q x q numbers -- bounded
by the column count -- and is the only thing the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import as_double
from ..session import ship_package
from .cells import matrix

WIDE = 16

@dataclass
class Moments:
    n: int
    mean: np.ndarray      # (q,)
    cov: np.ndarray       # (q, q) population covariance
    names: list[str]


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    cols = list(cols)
    q = len(cols)
    x = [as_double(c) for c in cols]
    if q > WIDE:
        return _wide(df, cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.avg(xi).alias(f"m{i}") for i, xi in enumerate(x)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(q) for j in range(i, q)]
    row = df.agg(*aggs).first()
    n = row["_n"]
    if not n:
        raise ValueError("empty input")
    mean = np.array([row[f"m{i}"] for i in range(q)], dtype=float)
    cov = np.zeros((q, q))
    for i in range(q):
        for j in range(i, q):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return Moments(n, mean, cov, cols)


def _wide(df: DataFrame, cols: list[str]) -> Moments:
    x, q = [as_double(c) for c in cols], len(cols)
    n, *mean = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in x]).first()
    if not n:
        raise ValueError("empty input")
    mean = np.array(mean, dtype=float)
    centre = np.nan_to_num(mean)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, q, q))         # products; sums of i where j is known; rows where both are
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(0)) - centre
                known = (~np.isnan(v)).astype(float)
                v = np.nan_to_num(v)
                total += np.stack([v.T @ v, v.T @ known, known.T @ known])
        flat = pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([flat], names=["s"])

    sums = (df.select(F.array(*x).alias("x")).mapInArrow(run, "s array<double>")
            .select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")))
    total = np.zeros(3 * q * q)
    for r in sums.collect():                # 3 x q x q rows
        total[r["i"]] = r["s"]
    products, part, rows = total.reshape(3, q, q)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = products / rows - (part / rows) * (part / rows).T
    return Moments(n, mean, cov, cols)


def pinv_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm least-squares solution of a x = b (symmetric a)."""
    return np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
