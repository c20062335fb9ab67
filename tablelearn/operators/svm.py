"""Support vector classifiers.

The kernel SVM of the reference is re-aimed as a *linear* SVM (hinge loss,
intercept unpenalised, solved to a duality gap by ``hinge.solve``, all class
pairs and candidates of a map in the same passes) over an explicit feature map:

* ``linear``  -- the features themselves (exact);
* ``poly``    -- all degree-d monomials scaled by sqrt(multinomial * gamma^d):
  the exact map of ``(gamma x.z)^d`` (coef0 = 0);
* ``rbf``     -- random Fourier features (Rahimi & Recht 2007), seeded,
  ``n_components`` of them (approximate);
* ``sigmoid`` -- Nystrom features on ``n_components`` seeded landmark rows
  (Williams & Seeger 2001; approximate, the kernel is not PSD).

More than two classes: one-vs-one fits on each class pair, majority vote
(ties -> smaller class).  Probabilities: Platt scaling of out-of-fold margins.
All maps are column expressions with literal coefficients (size fixed by p
and n_components, never by the rows).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import as_double, check_columns, check_numeric
from ..functions.exprs import num, qcol, sql_sum
from ..session import ship_package
from . import hinge

KERNELS = ("linear", "poly", "rbf", "sigmoid")
LEAST_ITER = 60          # a smaller max_iter doesn't cut a fit short
TASK_VALUES = 2_000_000  # mapped rows times their width of a task, about
TASK_WORK = 1_000_000    # rows times problems of a task, about


@dataclass
class FeatureMap:
    kernel: str
    features: list[str]
    gamma: float
    degree: int = 3
    W: np.ndarray | None = None      # rbf frequencies (D, p) / sigmoid landmarks (m, p)
    b: np.ndarray | None = None      # rbf phases
    T: np.ndarray | None = None      # nystrom whitening (m, m)
    monomials: list = field(default_factory=list)

    def columns(self) -> list[Column]:
        x = [f"_x{j}" for j in range(len(self.features))]
        if self.kernel == "linear":
            return [F.col(c) for c in x]
        if self.kernel == "poly":
            out = []
            for alpha, coef in self.monomials:
                term = " * ".join(f"{x[j]}" for j, a in enumerate(alpha) for _ in range(a))
                out.append(F.expr(f"({num(coef)} * {term})"))
            return out
        raise ValueError("rbf / sigmoid maps are computed per Arrow batch (transform)")

    def rows(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*[F.col(k) for k in keep],
                         *[as_double(c).alias(f"_x{j}") for j, c in enumerate(self.features)])

    @property
    def width(self) -> int:
        """Of a mapped row."""
        return {"linear": len(self.features), "poly": len(self.monomials), "rbf": 0 if self.b is None else len(self.b),
                "sigmoid": 0 if self.T is None else self.T.shape[1]}[self.kernel]

    def kernel_map(self):
        """rbf / sigmoid: a function from a block of rows to the mapped ones; None if ``columns`` makes them."""
        if self.kernel in ("linear", "poly"):
            return None
        kernel, W, b, whiten, g = self.kernel, self.W, self.b, self.T, self.gamma

        def made(x):
            if kernel == "rbf":
                return np.sqrt(2.0 / len(b)) * np.cos(x @ W.T + b)
            return np.tanh(g * (x @ W.T)) @ whiten
        return made

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., _phi array<double>): the mapped rows; with rbf / sigmoid, the rows that ``kernel_map`` takes."""
        xs = self.rows(df, keep)
        cols = ([F.col(f"_x{j}") for j in range(len(self.features))] if self.kernel_map() else self.columns())
        return xs.select(*[F.col(k) for k in keep], F.array(*cols).alias("_phi"))

    def margins(self, df: DataFrame, keep: Sequence[str], planes: Sequence[tuple]) -> DataFrame:
        """(keep..., _f0, _f1, ...): the value of each plane (w, intercept) at each row."""
        xs, names = self.rows(df, keep), [f"_f{i}" for i in range(len(planes))]
        if self.kernel in ("linear", "poly"):
            cols = [f"_phi{i}" for i in range(len(planes[0][0]))]
            phi = xs.select(*[F.col(k) for k in keep], *[c.alias(n) for c, n in zip(self.columns(), cols)])
            return phi.select(*[F.col(k) for k in keep], *[
                F.expr(sql_sum([num(b)] + [f"({c} * {num(v)})" for c, v in zip(cols, w) if v != 0.0])).alias(n)
                for n, (w, b) in zip(names, planes)])
        W, b = np.stack([w for w, _ in planes], axis=1), np.array([b for _, b in planes])
        return self._arrow_map(xs, keep, [(n, T.DoubleType()) for n in names], lambda z: list((z @ W + b).T))

    def _arrow_map(self, xs: DataFrame, keep: Sequence[str], out: list, made) -> DataFrame:
        """rbf / sigmoid: a dense matrix product per Arrow batch; ``made`` gives the columns ``out`` from it."""
        ship_package(xs.sparkSession)
        mapped = self.kernel_map()
        xcols, keep = [f"_x{j}" for j in range(len(self.features))], list(keep)
        schema = T.StructType([xs.schema[k] for k in keep] + [T.StructField(n, t) for n, t in out])

        def fmap(batches):
            import pandas as pd
            for pdf in batches:
                z = mapped(pdf[xcols].to_numpy(float))
                new = pd.DataFrame(dict(zip([n for n, _ in out], made(z))), index=pdf.index)
                yield pd.concat([pdf[keep], new], axis=1)
        return xs.mapInPandas(fmap, schema)


def _gamma(df, features, gamma):
    if isinstance(gamma, (int, float)):
        return float(gamma)
    g = str(gamma).strip().lower()
    p = len(features)
    if g == "auto":
        return 1.0 / p
    if g != "scale":
        return float(g)
    # 1 / (p * Var(X)) with the variance over all feature values
    stack = ", ".join(f"CAST({qcol(c)} AS DOUBLE)" for c in features)
    v = df.select(F.expr(f"stack({p}, {stack}) AS (x)")).agg(F.var_pop("x")).first()[0]
    return 1.0 / (p * v) if v and v > 0 else 1.0


def build_map(df: DataFrame, features: Sequence[str], kernel: str = "rbf", gamma="scale",
              degree: int = 3, n_components: int = 256, seed: int = 42, id: str = "id"
              ) -> FeatureMap:
    kernel = kernel.strip().lower()
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; choose one of {KERNELS}")
    features = list(features)
    g = _gamma(df, features, gamma)
    p = len(features)
    rng = np.random.default_rng(seed)
    if kernel == "linear":
        return FeatureMap(kernel, features, g)
    if kernel == "poly":
        mons = []
        for combo in itertools.combinations_with_replacement(range(p), degree):
            alpha = [combo.count(j) for j in range(p)]
            mult = math.factorial(degree) / math.prod(math.factorial(a) for a in alpha)
            mons.append((alpha, math.sqrt(mult * g ** degree)))
        return FeatureMap(kernel, features, g, degree, monomials=mons)
    if kernel == "rbf":
        W = rng.normal(0.0, math.sqrt(2.0 * g), size=(n_components, p))
        b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
        return FeatureMap(kernel, features, g, W=W, b=b)
    # sigmoid: landmarks = the n_components rows with the smallest md5(seed:id)
    m = n_components
    lm = (df.select(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))).alias("_h"),
                    *[as_double(c).alias(c) for c in features])
          .orderBy("_h").limit(m).collect())       # bounded by n_components
    L = np.array([[r[c] for c in features] for r in lm], dtype=float)
    K = np.tanh(g * L @ L.T)
    vals, vecs = np.linalg.eigh(K)
    keep = vals > 1e-10 * max(vals.max(), 1e-300)
    T = vecs[:, keep] / np.sqrt(vals[keep])
    return FeatureMap(kernel, features, g, W=L, T=T)


@dataclass
class SVMModel:
    fmap: FeatureMap
    classes: list
    pairs: list                     # [(a, b, w, intercept)] decision > 0 -> b
    platt: list | None = None       # (A, B) of each pair, for probabilities
    gaps: list[float] = field(default_factory=list)     # duality gap of each pair

    def decision(self, df: DataFrame, id: str, keep: Sequence[str]) -> DataFrame:
        return self.fmap.margins(df, [id, *keep], [(w, b) for _, _, w, b in self.pairs])

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = (),
                proba: bool = True) -> DataFrame:
        d = self.decision(df, id, keep)
        base = [F.col(id), *[F.col(k) for k in keep]]
        if len(self.classes) == 2:
            a, b = self.classes
            out = [F.when(F.col("_f0") > 0, F.lit(b)).otherwise(F.lit(a)).alias("prediction")]
            if proba and self.platt:
                A, B = self.platt[0]
                p1 = F.expr(f"1.0D / (1.0D + exp(-({num(A)} * _f0 + {num(B)})))")
                out += [(F.lit(1.0) - p1).alias(f"p_{a}"), p1.alias(f"p_{b}")]
            return d.select(*base, *out, F.col("_f0").alias("margin"))
        k = len(self.classes)
        idx = {c: i for i, c in enumerate(self.classes)}
        votes = []
        for ci in range(k):
            terms = []
            for i, (a, b, _, _) in enumerate(self.pairs):
                if idx[b] == ci:
                    terms.append(f"IF(_f{i} > 0, 1, 0)")
                elif idx[a] == ci:
                    terms.append(f"IF(_f{i} > 0, 0, 1)")
            votes.append(F.expr(" + ".join(terms) if terms else "0").alias(f"_v{ci}"))
        t = d.select(*base, *[F.col(f"_f{i}") for i in range(len(self.pairs))], *votes)
        v = [f"_v{i}" for i in range(k)]
        pick = ("CASE " + " ".join(f"WHEN {v[i]} = greatest({', '.join(v)}) THEN {i}"
                                   for i in range(k)) + " END")
        cls = F.array(*[F.lit(c) for c in self.classes])
        out = [cls[F.expr(pick)].alias("prediction")]
        if proba and self.platt:
            # pairwise probabilities, averaged: p_i = 2 / (k (k - 1)) * sum over j of r_ij
            share = {c: [] for c in self.classes}
            for i, ((a, b, _, _), (A, B)) in enumerate(zip(self.pairs, self.platt)):
                r = f"(1.0D / (1.0D + exp(-({num(A)} * _f{i} + {num(B)}))))"
                share[b].append(r)
                share[a].append(f"(1.0D - {r})")
            out += [(F.expr(" + ".join(share[c])) * (2.0 / (k * (k - 1)))).alias(f"p_{c}")
                    for c in self.classes]
        return t.select(*base, *out)


def _planes(fmap: FeatureMap, df: DataFrame, label: str, problems: list[tuple], max_iter: int) -> list[hinge.Plane]:
    """A plane for each problem (C, class of the negative side, of the positive side, which rows it has)."""
    y = F.array(*[F.when(~inside, 0.0).when(F.col(label) == F.lit(b), 1.0).when(F.col(label) == F.lit(a), -1.0)
                  .otherwise(0.0) for _, a, b, inside in problems])
    phi = fmap.transform(df.withColumn("_y", y), ["_y"]).select("_phi", "_y")
    # every pass is a job over these rows: as many tasks as they are worth, however few files hold them
    n = df.count()
    tasks = max(n * fmap.width // TASK_VALUES, n * len(problems) // TASK_WORK) + 1
    phi = phi.coalesce(1) if tasks == 1 else phi.repartition(tasks)
    # an unfinished interior point has no support vectors yet, and some 20 iterations finish it
    return hinge.solve(phi, [c for c, *_ in problems], fmap.width, tasks, max_iter=max(max_iter, LEAST_ITER),
                       mapped=fmap.kernel_map())


def fit_problems(rows: DataFrame, features: Sequence[str], label: str, candidates: Sequence[dict], parts: int,
                 at: str, id: str = "id", max_iter: int = 60) -> dict[tuple[int, int], SVMModel]:
    """Models of all (candidate, part); ``at`` is -1 for a part's test rows (see ``neighbors.knn_problems``).

    Problems that have a feature map in common are solved in the same passes:
    with a linear kernel all of them, else the candidates' C of a part.
    """
    features = list(features)
    check_numeric(rows, features)
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("SVM needs at least two classes")
    sides = list(itertools.combinations(classes, 2))
    groups = {}
    for c, q in enumerate(candidates):
        kernel = str(q.get("kernel", "rbf")).strip().lower()
        of = (kernel,) if kernel == "linear" else (kernel, q.get("gamma", "scale"), int(q.get("degree", 3)))
        for f in range(parts):
            groups.setdefault((of, None if kernel == "linear" else f), []).append((c, f, float(q.get("C", 1.0))))

    def one(item):
        (of, part), some = item
        mine = rows if part is None else rows.where(F.col(at)[part] >= 0)
        fmap = build_map(mine, features, *of, id=id)
        planes = iter(_planes(fmap, mine, label, [(C, a, b, F.col(at)[f] >= 0) for _, f, C in some for a, b in sides],
                              max_iter))
        return {(c, f): _model(fmap, classes, sides, [next(planes) for _ in sides]) for c, f, _ in some}

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as ex:       # maps are independent jobs
        return {k: m for got in ex.map(one, groups.items()) for k, m in got.items()}


def _model(fmap: FeatureMap, classes: list, sides: list, planes: list[hinge.Plane]) -> SVMModel:
    return SVMModel(fmap, classes, [(a, b, p.w, p.b) for (a, b), p in zip(sides, planes, strict=True)],
                    gaps=[p.gap for p in planes])


def fit(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
        kernel: str = "rbf", gamma="scale", degree: int = 3, n_components: int = 256,
        seed: int = 42, probability: bool = False, id: str = "id",
        max_iter: int = 60) -> SVMModel:
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [label, id])
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("SVM needs at least two classes")
    fmap = build_map(df, features, kernel, gamma, degree, n_components, seed, id)
    sides = list(itertools.combinations(classes, 2))
    planes = _planes(fmap, df, label, [(C, a, b, F.lit(True)) for a, b in sides], max_iter)
    model = _model(fmap, classes, sides, planes)
    if probability:      # one sigmoid for each pair of classes
        model.platt = [_platt(df.where(F.col(label).isin(a, b)), features, label, C, kernel, gamma,
                              degree, n_components, seed, id, max_iter, [a, b])
                       for a, b in sides]
    return model


def _linear_fold_margins(folds, features, label, C, id, max_iter, classes, cv: int) -> DataFrame:
    """(id, label, _f0): each row's margin by the plane that its fold's other rows give; all planes in one solve."""
    fmap = build_map(folds, features, "linear", id=id, gamma=1.0)
    planes = _planes(fmap, folds, label, [(C, *classes, F.col("fold") != f) for f in range(cv)], max_iter)
    d = fmap.margins(folds, [id, label, "fold"], [(p.w, p.b) for p in planes])
    return d.select(id, label, F.array(*[F.col(f"_f{f}") for f in range(cv)])[F.col("fold").cast("int")].alias("_f0"))


def _platt(df, features, label, C, kernel, gamma, degree, n_components, seed, id, max_iter,
           classes, cv: int = 5):
    """Sigmoid fit of out-of-fold margins (one-feature Newton logistic)."""
    from . import logistic
    from .split import stratified_folds
    folds = stratified_folds(df, label, cv, id).persist()
    if kernel.strip().lower() == "linear":      # all folds have the map in common: one solver's passes for them
        margins = _linear_fold_margins(folds, features, label, C, id, max_iter, classes, cv)
    else:
        def one(f):
            m = fit(folds.where(F.col("fold") != f), features, label, C, kernel, gamma, degree,
                    n_components, seed, False, id, max_iter)
            return m.decision(folds.where(F.col("fold") == f), id, [label]).select(
                id, label, "_f0")
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(cv) as ex:
            outs = list(ex.map(one, range(cv)))
        margins = outs[0]
        for o in outs[1:]:
            margins = margins.unionByName(o)
    # targets a little inside (0, 1), so that separable margins have a solution too
    n = {r[label]: r["count"] for r in margins.groupBy(label).count().collect()}
    lo, hi = 1.0 / (n[classes[0]] + 2.0), (n[classes[1]] + 1.0) / (n[classes[1]] + 2.0)
    lm = logistic.newton_binary(margins.withColumnRenamed("_f0", "margin"), ["margin"], label,
                                classes, C=None, targets=(lo, hi))
    folds.unpersist()
    return float(lm.coef[0, 0]), float(lm.intercept[0])


def support_counts(model: SVMModel, df: DataFrame, label: str, id: str = "id",
                   tol: float = 1e-3) -> DataFrame:
    """(class, n_support): rows on or inside a margin, y * f(x) <= 1 + tol.

    With more than two classes a row counts once if it supports any of the
    pairs that its class is in.
    """
    d = model.decision(df, id, [label])
    near = F.lit(False)
    for i, (a, b, _, _) in enumerate(model.pairs):
        y = F.when(F.col(label) == F.lit(b), 1.0).when(F.col(label) == F.lit(a), -1.0)
        near = near | F.coalesce(y * F.col(f"_f{i}") <= 1.0 + tol, F.lit(False))
    return (d.where(near).groupBy(F.col(label).alias("class"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_support")))
