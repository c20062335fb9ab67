"""Naive Bayes: gaussian, multinomial, bernoulli.

Fit = one ``groupBy(label)`` with per-feature sums (partial aggregation; the
result has one row per class).  The fitted model has classes x features
numbers -- a size fixed by the schema, not the data -- and prediction
inlines them as literals, so scoring is a narrow projection over the test
rows (no join, no shuffle).
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
from ..functions.exprs import num, qcol, sql_sum
from ..session import ship_package

MODELS = ("gaussian", "multinomial", "bernoulli")
# above this many class x feature terms, the same sums run in numpy per Arrow
# batch (a fused JVM expression would exceed the codegen limits); results agree
WIDE_TERMS = 256


@dataclass
class NaiveBayesModel:
    kind: str
    features: list[str]
    classes: list
    log_prior: np.ndarray          # (k,)
    theta: np.ndarray              # (k, p): mean / log prob
    sigma: np.ndarray | None = None  # (k, p): variance (gaussian)
    neg: np.ndarray | None = None    # (k, p): log(1 - p) (bernoulli)
    label_type: object = None

    def joint_log_likelihood(self) -> list[Column]:
        """Per-class expressions over the columns ``_x0..`` (see ``predict``).

        Built as one SQL string per class (a single parse instead of
        thousands of column-API calls) with a balanced sum.
        """
        p = len(self.features)
        x = [f"_x{j}" for j in range(p)]
        out = []
        for ci in range(len(self.classes)):
            terms = [num(self.log_prior[ci])]
            if self.kind == "gaussian":
                terms.append(num(-0.5 * float(np.sum(np.log(2.0 * np.pi * self.sigma[ci])))))
                for j in range(p):
                    terms.append(f"(({x[j]} - {num(self.theta[ci, j])}) * ({x[j]} - "
                                 f"{num(self.theta[ci, j])}) * {num(-0.5 / self.sigma[ci, j])})")
            elif self.kind == "multinomial":
                terms += [f"({x[j]} * {num(self.theta[ci, j])})" for j in range(p)]
            else:
                terms += [f"(IF({x[j]} > 0, {num(self.theta[ci, j])}, {num(self.neg[ci, j])}))"
                          for j in range(p)]
            out.append(F.expr(sql_sum(terms)))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Joint log likelihoods, rows x classes."""
        if self.kind == "gaussian":
            inv = -0.5 / self.sigma
            const = self.log_prior - 0.5 * np.sum(np.log(2.0 * np.pi * self.sigma), axis=1)
            return const + np.stack([((x - m) ** 2 * q).sum(axis=1) for m, q in zip(self.theta, inv, strict=True)], axis=1)
        if self.kind == "multinomial":
            return x @ self.theta.T + self.log_prior
        return np.where(np.isnan(x), np.nan, x > 0) @ (self.theta - self.neg).T + self.log_prior + self.neg.sum(axis=1)

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = (),
                proba: bool = True) -> DataFrame:
        """(id, keep..., prediction, p_<class>...) -- argmax, ties -> first class.

        Three narrow projections: features as doubles, one joint log
        likelihood column per class, then argmax / normalised probabilities.
        """
        k = len(self.classes)
        if k * len(self.features) > WIDE_TERMS:
            return self._predict_arrow(df, id, keep, proba)
        ids = [F.col(id), *[F.col(c) for c in keep]]
        xs = df.select(*ids, *[as_double(c).alias(f"_x{j}")
                               for j, c in enumerate(self.features)])
        jl = xs.select(*ids, *[e.alias(f"_j{i}") for i, e in
                               enumerate(self.joint_log_likelihood())])
        j = [f"_j{i}" for i in range(k)]
        mx = f"greatest({', '.join(j)})" if k > 1 else j[0]
        pred = "CASE " + " ".join(f"WHEN {j[i]} = _mx THEN {i}" for i in range(k)) + " END"
        t = jl.select(*ids, *[F.col(c) for c in j], F.expr(mx).alias("_mx"))
        cls = F.array(*[F.lit(c) for c in self.classes])
        cols = [F.col(id), *[F.col(c) for c in keep],
                F.when(F.expr(f"{' + '.join(j)} IS NOT NULL"), cls[F.expr(pred)])
                .alias("prediction")]
        if proba:
            t = t.select("*", *[F.expr(f"exp({j[i]} - _mx)").alias(f"_e{i}") for i in range(k)])
            tot = sql_sum([f"_e{i}" for i in range(k)])
            t = t.withColumn("_tot", F.expr(tot))
            cols += [(F.col(f"_e{i}") / F.col("_tot")).alias(f"p_{c}")
                     for i, c in enumerate(self.classes)]
        return t.select(*cols)

    def _predict_arrow(self, df, id, keep, proba):
        ship_package(df.sparkSession)
        import pandas as pd
        feats = [f"_x{j}" for j in range(len(self.features))]
        xs = df.select(F.col(id), *[F.col(c) for c in keep],
                       *[as_double(c).alias(f) for c, f in zip(self.features, feats)])
        kind, lp, th = self.kind, self.log_prior, self.theta
        if kind == "gaussian":
            inv = -0.5 / self.sigma                      # (k, p)
            const = lp - 0.5 * np.sum(np.log(2.0 * np.pi * self.sigma), axis=1)
        elif kind == "multinomial":
            lin, const = th.T, lp
        else:
            lin, const = (th - self.neg).T, lp + self.neg.sum(axis=1)
        classes = list(self.classes)
        out_cols = [id, *keep]
        schema = xs.select(F.col(id), *[F.col(c) for c in keep]).schema
        from pyspark.sql.types import DoubleType, StructField, StructType
        fields = list(schema.fields) + [StructField("prediction", self.label_type)]
        if proba:
            fields += [StructField(f"p_{c}", DoubleType()) for c in classes]

        def score(batches):
            for b in batches:
                x = b[feats].to_numpy(dtype=float)
                if kind == "bernoulli":
                    x = (x > 0).astype(float)
                if kind == "gaussian":   # differences first, as the column path has them
                    jll = const + np.stack([((x - m) ** 2 * q).sum(axis=1)
                                            for m, q in zip(th, inv)], axis=1)
                else:
                    jll = x @ lin + const
                known = ~np.isnan(jll).any(axis=1)
                best = np.argmax(jll, axis=1)
                res = b[out_cols].copy()
                res["prediction"] = pd.Series([classes[i] if ok else None
                                               for i, ok in zip(best, known)],
                                              index=b.index, dtype=object)
                if proba:
                    e = np.exp(jll - jll.max(axis=1, keepdims=True))
                    e = e / e.sum(axis=1, keepdims=True)
                    for i, c in enumerate(classes):
                        res[f"p_{c}"] = e[:, i]
                yield res
        return xs.mapInPandas(score, StructType(fields))

    def params(self, spark: SparkSession) -> DataFrame:
        rows = []
        for ci, c in enumerate(self.classes):
            for j, f in enumerate(self.features):
                rows.append((str(c), j, f, float(self.log_prior[ci]), float(self.theta[ci, j]),
                             None if self.sigma is None else float(self.sigma[ci, j])))
        return spark.createDataFrame(
            rows, "label string, pos int, feature string, log_prior double, theta double, "
                  "var double")


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str = "gaussian",
        alpha: float = 1.0, var_smoothing: float = 1e-9) -> NaiveBayesModel:
    kind = kind.strip().lower()
    if kind not in MODELS:
        raise ValueError(f"unknown model_type {kind!r}; choose one of {MODELS}")
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [label])
    p = len(features)
    # long form: (label, pos, x) -> groupBy(label, pos) with three aggregates;
    # small generated code for any p, partial aggregation before the shuffle
    stack = ", ".join(f"{j}, CAST({qcol(c)} AS DOUBLE)" for j, c in enumerate(features))
    lf = df.select(F.col(label).alias("_label"),
                   F.expr(f"stack({p}, {stack}) AS (pos, x)"))
    lf = lf.withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    if kind == "gaussian":
        stat = [F.avg("x").alias("m"), F.var_pop("x").alias("v")]
    elif kind == "multinomial":
        stat = [F.sum("x").alias("s"), F.min("x").alias("lo")]
    else:
        stat = [F.sum(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("s")]
    st = lf.groupBy("_label", "pos").agg(*stat).collect()     # classes x features rows
    nc = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["_label"]: r["_n"] for r in nc.collect()}    # one row per class
    classes = sorted(counts)
    cidx = {c: i for i, c in enumerate(classes)}
    per = {}
    for r in st:
        per[(cidx[r["_label"]], r["pos"])] = r
    per_class = [counts[c] for c in classes]
    if not per_class:
        raise ValueError("empty training set")
    k = len(classes)
    n_c = np.array(per_class, dtype=float)

    def mat(key):
        return np.array([[per[(i, j)][key] for j in range(p)] for i in range(k)], dtype=float)
    eps = 0.0
    if kind == "gaussian":
        allv = lf.groupBy("pos").agg(F.var_pop("x").alias("v")).collect()
        eps = var_smoothing * max((r["v"] or 0.0) for r in allv)
    keys = {"gaussian": "mv", "multinomial": ("s", "lo"), "bernoulli": "s"}[kind]
    return _model(kind, features, classes, n_c, {key: mat(key) for key in keys}, eps, alpha, df.schema[label].dataType)


def _model(kind: str, features: list[str], classes: list, n_c: np.ndarray, stat: dict[str, np.ndarray], eps: float,
           alpha: float, label_type) -> NaiveBayesModel:
    """A model of class counts and classes x features matrices: m and v, s and lo, or s."""
    log_prior = np.log(n_c / n_c.sum())
    if kind == "gaussian":
        return NaiveBayesModel(kind, features, classes, log_prior, stat["m"], sigma=stat["v"] + eps,
                               label_type=label_type)
    if kind == "multinomial":
        if np.min(stat["lo"]) < 0:
            raise ValueError("negative values in data passed to MultinomialNB")
        sm = stat["s"] + alpha
        theta = np.log(sm) - np.log(sm.sum(axis=1, keepdims=True))
        return NaiveBayesModel(kind, features, classes, log_prior, theta, label_type=label_type)
    prob = (stat["s"] + alpha) / (n_c[:, None] + 2 * alpha)
    return NaiveBayesModel(kind, features, classes, log_prior, np.log(prob),
                           neg=np.log1p(-prob), label_type=label_type)


def fit_problems(rows: DataFrame, features: Sequence[str], label: str, candidates: Sequence[dict],
                 sizes: Sequence[int], parts: int, at: str,
                 var_smoothing: float = 1e-9) -> dict[tuple[int, int, int], NaiveBayesModel]:
    """Models of all (candidate, part, size) from one aggregate; see ``neighbors.knn_problems`` for ``at``.

    Rows are grouped by what they belong to: for each part, the first size
    that has them (-1 in a test row).  There are at most parts x (parts x
    sizes + 1) such groups, and a problem's moments are those of its groups,
    merged about their common mean.
    """
    features, sizes = list(features), [int(s) for s in sizes]
    check_numeric(rows, features)
    p = len(features)
    stack = ", ".join(f"{j}, CAST({qcol(c)} AS DOUBLE)" for j, c in enumerate(features))
    below = [F.when(F.col(at)[f] < 0, -1).otherwise(sum((F.when(F.col(at)[f] >= s, 1).otherwise(0) for s in sizes),
                                                        F.lit(0))) for f in range(parts)]
    lf = rows.select(F.array(*below).alias("_in"), F.col(label).alias("_label"), F.expr(f"stack({p}, {stack}) AS (pos, x)"))
    lf = lf.withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    st = lf.groupBy("_in", "_label", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), F.avg("x").alias("m"), F.var_pop("x").alias("v"),
        F.min("x").alias("lo"), F.sum("x").alias("s"), F.sum(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("pos_n")
    ).collect()                     # groups x classes x features rows
    groups = sorted({tuple(r["_in"]) for r in st})
    every = sorted({r["_label"] for r in st}, key=lambda c: (c is not None, c))
    where_g, where_c = {g: i for i, g in enumerate(groups)}, {c: i for i, c in enumerate(every)}
    table = {key: np.full((len(groups), len(every), p), np.inf if key == "lo" else 0.0)
             for key in ("n", "known", "m", "v", "lo", "s", "pos_n")}
    for r in st:
        for key in table:
            if r[key] is not None:
                table[key][where_g[tuple(r["_in"])], where_c[r["_label"]], r["pos"]] = r[key]
    label_type, inside = rows.schema[label].dataType, np.array(groups)

    def merged(known, m, v, axis):
        n = known.sum(axis)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (known * m).sum(axis) / n
            off = m - np.expand_dims(mean, axis)
            return n, mean, (known * (v + off * off)).sum(axis) / n

    out = {}
    for f in range(parts):
        for i in range(len(sizes)):
            some = (inside[:, f] >= 0) & (inside[:, f] <= i)
            have = np.flatnonzero(table["n"][some, :, 0].sum(0) > 0)
            if not len(have):
                raise ValueError("empty training set")
            part = {key: t[some][:, have] for key, t in table.items()}
            known, m, v = merged(part["known"], part["m"], part["v"], 0)
            n_c = part["n"][:, :, 0].sum(0)
            whole = merged(known, np.where(known > 0, m, 0.0), np.where(known > 0, v, 0.0), 0)[2]
            eps = var_smoothing * max(0.0 if math.isnan(x) else float(x) for x in whole)
            for c, q in enumerate(candidates):
                kind = str(q.get("model_type", "gaussian")).strip().lower()
                if kind not in MODELS:
                    raise ValueError(f"unknown model_type {kind!r}; choose one of {MODELS}")
                stat = {"m": m, "v": v, "s": part["pos_n" if kind == "bernoulli" else "s"].sum(0), "lo": part["lo"].min(0)}
                out[c, f, i] = _model(kind, features, [every[x] for x in have], n_c, stat, eps,
                                      float(q.get("alpha", 1.0)), label_type)
    return out


def predict_problems(models: dict[tuple[int, int, int], NaiveBayesModel], rows: DataFrame, label: str,
                     sizes: Sequence[int], at: str, train: bool = False) -> DataFrame:
    """(cand, part, size, seen, y, prediction) of each row that asks in a problem, in one pass."""
    ship_package(rows.sparkSession)
    features = next(iter(models.values())).features
    x = F.array(*[F.coalesce(as_double(c), F.lit(float("nan"))) for c in features])
    kind = rows.schema[label].dataType.simpleString()
    sizes = [int(s) for s in sizes]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            values, place = matrix(b.column(0)), matrix(b.column(1))
            for (c, f, i), model in models.items():
                who = np.flatnonzero(place[:, f] < (sizes[i] if train else 0))
                if not len(who):
                    continue
                score = model.scores(values[who])
                best = pa.array(np.argmax(score, axis=1), mask=np.isnan(score).any(axis=1))
                same = lambda v: pa.array(np.full(len(who), v, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [same(c), same(f), same(i), pa.array(place[who, f] >= 0), b.column(2).take(pa.array(who)),
                     pa.array(model.classes, b.column(2).type).take(best)],
                    names=["cand", "part", "size", "seen", "y", "prediction"])

    return rows.select(x.alias("x"), F.col(at).alias("at"), F.col(label).alias("y")).mapInArrow(
        run, f"cand int, part int, size int, seen boolean, y {kind}, prediction {kind}")
