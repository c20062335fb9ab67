"""Linear models: least squares, ridge, lasso, polynomial features.

All fits share one aggregate (``functions.linalg.moments``): means and the
centred covariance of features and label.  The p x p solve runs on the
driver; prediction inlines the coefficients as a linear expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_numeric
from ..functions.exprs import dot
from ..functions.linalg import moments, pinv_solve


@dataclass
class LinearModel:
    kind: str
    features: list[str]
    coef: np.ndarray
    intercept: float
    n_iter: int = 0

    def expression(self) -> Column:
        return dot([as_double(c) for c in self.features], self.coef, self.intercept)

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
        return df.select(F.col(id), *[F.col(k) for k in keep],
                         self.expression().alias("prediction"))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(pos, feature, coef, nonzero); the intercept is pos -1."""
        rows = [(-1, "(intercept)", float(self.intercept), True)]
        rows += [(i, c, float(w), bool(w != 0.0)) for i, (c, w) in
                 enumerate(zip(self.features, self.coef))]
        return spark.createDataFrame(rows, "pos int, feature string, coef double, nonzero boolean")


def _centred(df, features, label):
    features = list(features)
    check_numeric(df, features + [label])
    m = moments(df, features + [label])
    p = len(features)
    return m, m.cov[:p, :p], m.cov[:p, p], m.mean[:p], m.mean[p]


def linear_regression(df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
    """Least squares with intercept; minimum-norm solution when singular."""
    m, cxx, cxy, mx, my = _centred(df, features, label)
    w = pinv_solve(cxx, cxy)
    return LinearModel("linear", list(features), w, float(my - mx @ w))


def ridge_regression(df: DataFrame, features: Sequence[str], label: str,
                     alpha: float = 1.0) -> LinearModel:
    """min ||y - Xw - b||^2 + alpha ||w||^2 (intercept not penalised)."""
    m, cxx, cxy, mx, my = _centred(df, features, label)
    n = m.n
    w = np.linalg.solve(n * cxx + alpha * np.eye(len(mx)), n * cxy)
    return LinearModel("ridge", list(features), w, float(my - mx @ w))


def lasso_regression(df: DataFrame, features: Sequence[str], label: str,
                     alpha: float = 1.0, max_iter: int = 1000,
                     tol: float = 1e-12) -> LinearModel:
    """min 1/(2n) ||y - Xw - b||^2 + alpha ||w||_1 by coordinate descent on the
    centred covariance (exact optimum of the objective; p x p on the driver)."""
    m, cxx, cxy, mx, my = _centred(df, features, label)
    p = len(mx)
    w = np.zeros(p)
    it = 0
    for it in range(1, max_iter + 1):
        delta = 0.0
        for j in range(p):
            if cxx[j, j] <= 0:
                continue
            rho = cxy[j] - cxx[j] @ w + cxx[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / cxx[j, j]
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            break
    return LinearModel("lasso", list(features), w, float(my - mx @ w), it)


def sparsity(model: LinearModel, spark: SparkSession) -> DataFrame:
    """One row: n_features, nonzero, sparsity = 1 - nonzero / p."""
    p = len(model.coef)
    nnz = int(np.count_nonzero(model.coef))
    return spark.createDataFrame([(p, nnz, 1.0 - nnz / p)],
                                 "n_features int, nonzero int, sparsity double")


def polynomial_terms(features: Sequence[str], degree: int = 2,
                     include_bias: bool = False) -> list[tuple[str, Column]]:
    """Monomials of degree <= d in the order x, y, x^2, x y, y^2 (named that way)."""
    out = []
    if include_bias:
        out.append(("1", F.lit(1.0)))
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(range(len(features)), d):
            parts, e = [], None
            for j in sorted(set(combo)):
                k = combo.count(j)
                parts.append(features[j] if k == 1 else f"{features[j]}^{k}")
            for j in combo:
                e = as_double(features[j]) if e is None else e * as_double(features[j])
            out.append((" ".join(parts), e))
    return out


def polynomial_features(df: DataFrame, features: Sequence[str], degree: int = 2,
                        include_bias: bool = False, id: str = "id",
                        keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    terms = polynomial_terms(features, degree, include_bias)
    out = df.select(F.col(id), *[F.col(k) for k in keep], *[e.alias(n) for n, e in terms])
    return out, [n for n, _ in terms]


def polynomial_regression(df: DataFrame, features: Sequence[str], label: str,
                          degree: int = 2, include_bias: bool = False,
                          id: str = "id") -> LinearModel:
    poly, names = polynomial_features(df, features, degree, include_bias, id, keep=[label])
    model = linear_regression(poly, names, label)
    model.kind = "polynomial"
    return model


def polynomial_predict(model: LinearModel, df: DataFrame, features: Sequence[str],
                       degree: int, include_bias: bool = False, id: str = "id",
                       keep: Sequence[str] = ()) -> DataFrame:
    terms = dict(polynomial_terms(features, degree, include_bias))
    e = F.lit(float(model.intercept))
    for n, w in zip(model.features, model.coef):
        e = e + terms[n] * F.lit(float(w))
    return df.select(F.col(id), *[F.col(k) for k in keep], e.alias("prediction"))
