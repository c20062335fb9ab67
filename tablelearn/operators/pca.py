"""Principal components from one covariance aggregate.

The p x p sample covariance is aggregated by Spark, ``eigh`` runs on the
driver, and scores are a projection expression over the rows (centred),
so no data row leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_numeric
from ..functions.exprs import dot
from ..functions.linalg import moments


@dataclass
class PCAModel:
    features: list[str]
    mean: np.ndarray
    components: np.ndarray      # (k, p), rows = loadings
    eigenvalues: np.ndarray     # (k,)
    ratio: np.ndarray           # (k,)
    n: int

    def transform(self, df: DataFrame, id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
        xc = [as_double(c) - F.lit(float(m)) for c, m in zip(self.features, self.mean)]
        cols = [dot(xc, comp).alias(f"pc{k + 1}") for k, comp in enumerate(self.components)]
        return df.select(F.col(id), *[F.col(x) for x in keep], *cols)

    def variance(self, spark: SparkSession) -> DataFrame:
        cum = np.cumsum(self.ratio)
        rows = [(k + 1, float(ev), float(r), float(c)) for k, (ev, r, c) in
                enumerate(zip(self.eigenvalues, self.ratio, cum))]
        return spark.createDataFrame(
            rows, "component int, eigenvalue double, ratio double, cumulative double")

    def loadings(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, j, f, float(self.components[k, j]))
                for k in range(len(self.components)) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "component int, pos int, feature string, loading double")


def fit(df: DataFrame, features: Sequence[str], n_components: int = 2) -> PCAModel:
    """Eigen-decomposition of the sample covariance (divisor n - 1).

    ``n_components`` is clamped to p; each component's largest-magnitude
    loading is made positive (deterministic sign).
    """
    features = list(features)
    check_numeric(df, features)
    m = moments(df, features)
    if m.n < 2:
        raise ValueError("PCA needs at least 2 rows")
    cov = m.cov * m.n / (m.n - 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(-vals, kind="stable")
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order].T
    for k in range(len(vecs)):
        j = int(np.argmax(np.abs(vecs[k])))
        if vecs[k, j] < 0:
            vecs[k] = -vecs[k]
    k = max(1, min(int(n_components), len(features)))
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    return PCAModel(features, m.mean, vecs[:k], vals[:k], ratio[:k], m.n)
