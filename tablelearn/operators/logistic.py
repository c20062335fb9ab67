"""Logistic regression.

Binary L2 / unpenalised: Newton's method where each iteration is ONE Spark
aggregate producing the gradient and Hessian ((p+1)^2 numbers); converges
to the exact optimum of ``C * sum(logloss) + 1/2 ||w||^2`` in a handful of
passes.

L1, elastic net and more than two classes (softmax): proximal Newton.  Each
pass computes loss, gradient and Hessian from Arrow batches, a row per task,
summed by a grouped aggregate; the quadratic model with its L1 term is solved
on the driver, whose part is as large as the coefficients squared.  The end is
certified: ``residual`` is the largest violation of the optimality conditions
of any coefficient, per row of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.cells import matrix
from ..functions.exprs import dot
from ..session import ship_package

PENALTIES = ("l2", "l1", "elasticnet", "none")


@dataclass
class LogisticModel:
    features: list[str]
    classes: list
    coef: np.ndarray        # (k_rows, p): one row for binary
    intercept: np.ndarray   # (k_rows,)
    n_iter: int = 0
    converged: bool = True
    residual: float = math.nan

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: n_iter, converged, residual (not known after plain Newton)."""
        return spark.createDataFrame([(self.n_iter, self.converged, self.residual)],
                                     "n_iter int, converged boolean, residual double")

    def _margins(self) -> list[Column]:
        x = [as_double(c) for c in self.features]
        return [dot(x, self.coef[r], self.intercept[r]) for r in range(len(self.intercept))]

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = (),
                proba: bool = True) -> DataFrame:
        ms = self._margins()
        base = [F.col(id), *[F.col(k) for k in keep]]
        if len(self.classes) == 2:
            p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-ms[0]))
            cols = base + [F.when(ms[0] > 0, F.lit(self.classes[1]))
                           .otherwise(F.lit(self.classes[0])).alias("prediction")]
            if proba:
                cols += [(F.lit(1.0) - p1).alias(f"p_{self.classes[0]}"),
                         p1.alias(f"p_{self.classes[1]}")]
            return df.select(*cols)
        arr = F.array(*ms)
        t = df.select(*base, arr.alias("_m"))
        mx = F.array_max("_m")
        idx = (F.array_position(F.col("_m"), mx) - 1).cast("int")
        cls = F.array(*[F.lit(c) for c in self.classes])
        cols = [F.col(id), *[F.col(k) for k in keep], cls[idx].alias("prediction")]
        if proba:
            ex = F.transform("_m", lambda v: F.exp(v - mx))
            t = t.withColumn("_e", ex).withColumn(
                "_t", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
            cols += [(F.col("_e")[i] / F.col("_t")).alias(f"p_{c}")
                     for i, c in enumerate(self.classes)]
        return t.select(*cols)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(row, pos, feature, coef); intercept at pos -1.  Binary: row 0 only."""
        rows = []
        for r in range(len(self.intercept)):
            rows.append((r, -1, "(intercept)", float(self.intercept[r])))
            rows += [(r, j, f, float(self.coef[r, j])) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "row int, pos int, feature string, coef double")


def _classes(df, label):
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def newton_binary(df: DataFrame, features: Sequence[str], label: str, classes: list,
                  C: float | None = 1.0, max_iter: int = 100, tol: float = 1e-12,
                  targets: tuple[float, float] = (0.0, 1.0)) -> LogisticModel:
    """Exact Newton iterations; C=None means no penalty.

    A step that raises the loss is halved.  ``converged`` is false if the
    iterations ran out, or if the classes are separable and nothing bounds
    the coefficients.  ``targets`` are the two classes' values of y.
    """
    p = len(features)
    # iterative: keep the projected input in memory/disk across passes
    df = df.select(*[as_double(c).alias(c) for c in features], F.col(label)).persist()
    x = [F.lit(1.0)] + [F.col(c) for c in features]   # intercept first
    y = F.when(F.col(label) == F.lit(classes[1]), targets[1]).otherwise(targets[0])
    beta = np.zeros(p + 1)
    last, last_loss, converged = None, math.inf, False
    lam = 0.0 if C is None else 1.0 / C
    reg = np.eye(p + 1) * lam
    reg[0, 0] = 0.0
    it = 0
    for it in range(1, max_iter + 1):
        m = F.lit(float(beta[0]))
        for j in range(p):
            m = m + x[j + 1] * F.lit(float(beta[j + 1]))
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        wgt = s * (F.lit(1.0) - s)
        aggs = [F.sum((s - y) * x[i]).alias(f"g{i}") for i in range(p + 1)]
        aggs += [F.sum(wgt * x[i] * x[j]).alias(f"h{i}_{j}")
                 for i in range(p + 1) for j in range(i, p + 1)]
        loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - y * m
        row = df.agg(*aggs, F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("n")).first()
        now = row["loss"] + 0.5 * beta @ reg @ beta
        if last is not None and now > last_loss + 1e-9 * abs(last_loss) and np.max(np.abs(beta - last)) > tol:
            beta = (beta + last) / 2
            continue
        last, last_loss = beta, now
        if C is None and targets == (0.0, 1.0) and now < 1e-9 * max(1, row["n"]):
            break                                   # separable: the loss has no minimum
        g = np.array([row[f"g{i}"] for i in range(p + 1)]) + reg @ beta
        h = np.zeros((p + 1, p + 1))
        for i in range(p + 1):
            for j in range(i, p + 1):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.lstsq(h + reg, g, rcond=None)[0]
        beta = beta - step
        if np.max(np.abs(step)) < tol:
            converged = True
            break
    df.unpersist()
    return LogisticModel(list(features), classes, beta[None, 1:], beta[:1], it, converged)


def _measure(data: DataFrame, beta: np.ndarray, k: int) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """Rows, rows with a gap, loss, gradient and Hessian at ``beta`` (free rows x (intercept, features))."""
    free, q = beta.shape                    # one row for two classes: the first has margin 0
    m = free * q

    def run(batches):
        total = np.zeros(3 + m + m * m)
        for part in batches:
            if not part.num_rows:
                continue
            y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = np.hstack([np.ones((len(y), 1)), matrix(part.column(0))])
            gaps = np.isnan(x).any(axis=1) | np.isnan(y)
            total[:2] += len(y), gaps.sum()
            if gaps.any():
                continue
            margin = x @ beta.T
            if free < k:
                margin = np.hstack([np.zeros((len(y), 1)), margin])
            top = margin.max(axis=1)
            e = np.exp(margin - top[:, None])
            whole = e.sum(axis=1)
            true = y.astype(np.int64)
            total[2] += (top + np.log(whole) - margin[np.arange(len(y)), true]).sum()
            prob = (e / whole[:, None])[:, k - free:]
            total[3:3 + m] += ((prob - (true[:, None] == np.arange(k - free, k))).T @ x).ravel()
            h = np.empty((free, q, free, q))
            for r in range(free):
                for c in range(r, free):
                    block = x.T @ ((prob[:, r] * ((r == c) - prob[:, c]))[:, None] * x)
                    h[r, :, c], h[c, :, r] = block, block.T
            total[3 + m:] += h.ravel()
        flat = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([flat], names=["s"])

    sums = data.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    total = np.zeros(3 + m + m * m)
    for r in sums.groupBy("i").agg(F.sum("s").alias("s")).collect():      # as many rows as the Hessian has numbers
        total[r["i"]] = r["s"]
    return total[0], total[1], total[2], total[3:3 + m], total[3 + m:].reshape(m, m)


def _goal(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic model at ``beta`` with its penalties."""
    a, c = h + np.diag(l2), h @ beta - g
    if not l1.any():
        return beta - np.linalg.lstsq(a, g + l2 * beta, rcond=None)[0]
    z = beta.copy()
    for _ in range(1000):
        for j in range(len(z)):
            if a[j, j] > 0:
                r = c[j] - a[j] @ z + a[j, j] * z[j]
                z[j] = np.sign(r) * max(abs(r) - l1[j], 0.0) / a[j, j]
        # the exact minimum for these signs, if it has them and no other coefficient wants to move
        on = (l1 == 0) | (z != 0)
        exact = np.zeros(len(z))
        exact[on] = np.linalg.lstsq(a[np.ix_(on, on)], c[on] - np.sign(z[on]) * l1[on], rcond=None)[0]
        pull = np.abs(c - a @ exact)
        if (np.sign(exact) == np.sign(z))[on & (l1 > 0)].all() and (pull[~on] <= l1[~on] * (1 + 1e-12)).all():
            return exact
    return z


def proximal_newton(df: DataFrame, features: Sequence[str], label: str, classes: list, C: float | None = 1.0,
                    l1_ratio: float = 0.0, max_iter: int = 100, tol: float = 1e-10) -> LogisticModel:
    """min sum(logloss) + (l1_ratio ||w||_1 + (1 - l1_ratio) / 2 ||w||^2) / C; intercepts are free.

    Two classes have one row of coefficients, more have one each, with
    intercepts that sum to zero.  C=None means no penalty.  Steps that raise
    the objective are halved.  ``converged`` is false if the violation of the
    optimality conditions stayed above ``tol`` a row, or if nothing bounds the
    coefficients of separable classes.  A missing feature or label is an error.
    """
    features, k = list(features), len(classes)
    free, q = 1 if k == 2 else k, len(features) + 1
    lam = 0.0 if C is None else 1.0 / C
    each = np.ones((free, q))
    each[:, 0] = 0.0
    l1, l2 = (each * lam * l1_ratio).ravel(), (each * lam * (1 - l1_ratio)).ravel()
    code = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(float(i))) for i, c in enumerate(classes) if c is not None],
                      F.lit(None))
    ship_package(df.sparkSession)
    data = df.select(F.array(*[as_double(c) for c in features]).alias("x"), code.alias("y")).persist()
    objective = lambda at, loss: loss + 0.5 * (l2 * at * at).sum() + (l1 * np.abs(at)).sum()

    def violation(at, gradient):
        pull = gradient + l2 * at
        resting = np.maximum(np.abs(pull) - l1, 0.0)
        return np.max(np.where((at == 0) & (l1 > 0), resting, np.abs(pull + l1 * np.sign(at))))

    beta = np.zeros(free * q)
    n, gaps, loss, g, h = _measure(data, beta.reshape(free, q), k)
    if gaps:
        data.unpersist()
        raise ValueError(f"{int(gaps)} rows have a missing feature or label; impute or drop them first")
    now, it, converged = objective(beta, loss), 0, violation(beta, g) <= tol * n
    while not converged and it < max_iter:
        it += 1
        goal, scale, better = _goal(beta, g, h, l1, l2), 1.0, False
        while not better and scale > 1e-9:
            trial = beta + scale * (goal - beta) if scale < 1 else goal
            _, _, loss, g_new, h_new = _measure(data, trial.reshape(free, q), k)
            better = objective(trial, loss) <= now + 1e-12 * abs(now)
            scale /= 2
        if not better:
            break
        beta, g, h, now = trial, g_new, h_new, objective(trial, loss)
        converged = violation(beta, g) <= tol * n
        if C is None and loss < 1e-9 * n:
            converged = False                   # separable: the loss has no minimum
            break
    data.unpersist()
    residual, beta = violation(beta, g) / n, beta.reshape(free, q)
    intercept = beta[:, 0] - (beta[:, 0].mean() if free > 1 else 0.0)
    return LogisticModel(features, classes, beta[:, 1:], intercept, it, bool(converged), float(residual))


def share_balance(model: LogisticModel, df: DataFrame, label: str, C: float | None = 1.0) -> DataFrame:
    """(class, pos, feature, balance): what optimality says of a softmax model under L2, in expressions of its own.

    At the optimum the mean over rows of p_class * x_feature, plus the
    coefficient over C n, is the mean of x_feature over the rows of the class
    (0 elsewhere).  ``balance`` is the left side; pos -1 is the intercept's.
    """
    names = [f"_x{j}" for j in range(len(model.features))]
    probs = [f"p_{c}" for c in model.classes]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *[as_double(c).alias(c) for c in model.features])
    pred = model.predict(rows, "_row", keep=model.features).toDF("_row", *names, "_pred", *probs)
    terms = [(i, j) for i in range(len(probs)) for j in range(-1, len(names))]
    got = pred.agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.col(probs[i]) * (F.col(names[j]) if j >= 0 else F.lit(1.0))).alias(f"b{i}_{j}") for i, j in terms]).first()
    lam = 0.0 if C is None else 1.0 / (C * got["n"])
    return df.sparkSession.createDataFrame(
        [(str(model.classes[i]), j, model.features[j] if j >= 0 else "(intercept)",
          float(got[f"b{i}_{j}"] + (lam * model.coef[i, j] if j >= 0 else 0.0))) for i, j in terms],
        "class string, pos int, feature string, balance double")


def fit(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
        penalty: str = "l2", l1_ratio: float = 0.5, max_iter: int = 1000) -> LogisticModel:
    penalty = penalty.strip().lower()
    if penalty not in PENALTIES:
        raise ValueError(f"unknown penalty {penalty!r}; choose one of {PENALTIES}")
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [label])
    classes = _classes(df, label)
    if len(classes) < 2:
        raise ValueError("logistic regression needs at least 2 classes")
    if len(classes) == 2 and penalty in ("l2", "none"):
        return newton_binary(df, features, label, classes,
                             None if penalty == "none" else C, max_iter=max_iter)
    ratio = {"l1": 1.0, "elasticnet": float(l1_ratio)}.get(penalty, 0.0)
    return proximal_newton(df, features, label, classes, None if penalty == "none" else C, ratio, max_iter)
