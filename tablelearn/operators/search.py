"""Model registry, cross-validation, grid search and learning curves.

Folds are a column (``split.stratified_folds`` for classifiers, contiguous
id blocks for regression).  k-NN, naive Bayes and SVM (``SHARED``) answer all
(candidate, size, fold) problems together: one neighbour search whose blocks
are compared once, one aggregate of moments that problems share, or passes
that solve all problems of a feature map; one grouped aggregate scores them.  Of the other models, every
(candidate, fold) fit is an independent set of Spark jobs over the cached
feature table, submitted from a small thread pool so several run at once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_columns
from ..functions.rank import global_rank
from ..session import cut_lineage
from . import metrics
from .split import stratified_folds, train_test_split

PARALLEL_FITS = 4


# ---- registry (E9) ------------------------------------------------------------------
def _logistic(train, test, features, label, id, keep, proba, **p):
    from . import logistic as lg
    m = lg.fit(train, features, label, C=float(p.get("C", 1.0)),
               penalty=str(p.get("penalty", "l2")), max_iter=int(p.get("max_iter", 1000)))
    return m.predict(test, id, keep=keep, proba=proba)


def _knn(train, test, features, label, id, keep, proba, **p):
    from . import knn
    return knn.classify(train, test, features, label, k=int(p.get("n_neighbors", 5)),
                        weights=str(p.get("weights", "uniform")), p=float(p.get("p", 2)),
                        id=id, keep=keep)


def _svm(train, test, features, label, id, keep, proba, **p):
    from . import svm
    m = svm.fit(train, features, label, C=float(p.get("C", 1.0)),
                kernel=str(p.get("kernel", "rbf")), gamma=p.get("gamma", "scale"),
                degree=int(p.get("degree", 3)), id=id, probability=proba)
    return m.predict(test, id, keep=keep, proba=proba)


def _tree(train, test, features, label, id, keep, proba, **p):
    from . import tree
    m = tree.fit(train, features, label, id, criterion=str(p.get("criterion", "gini")),
                 max_depth=p.get("max_depth"), min_samples_split=int(p.get("min_samples_split", 2)),
                 min_samples_leaf=int(p.get("min_samples_leaf", 1)))
    return m.predict(test, id, keep=keep)


def _forest(train, test, features, label, id, keep, proba, **p):
    from . import forest
    m = forest.fit(train, features, label, "classification",
                   n_estimators=int(p.get("n_estimators", 100)), max_depth=p.get("max_depth"),
                   min_samples_split=int(p.get("min_samples_split", 2)),
                   min_samples_leaf=int(p.get("min_samples_leaf", 1)),
                   max_features=str(p.get("max_features", "sqrt")), seed=int(p.get("seed", 42)), id=id)
    return m.predict(test, id, keep=keep)


def _nb(train, test, features, label, id, keep, proba, **p):
    from . import bayes
    m = bayes.fit(train, features, label, str(p.get("model_type", "gaussian")),
                  alpha=float(p.get("alpha", 1.0)))
    return m.predict(test, id, keep=keep, proba=proba)


def _linear(train, test, features, label, id, keep, proba, **p):
    from . import linear
    return linear.linear_regression(train, features, label).predict(test, id, keep=keep)


MODELS: dict[str, Callable] = {"logistic": _logistic, "knn": _knn, "svm": _svm,
                               "tree": _tree, "forest": _forest, "nb": _nb,
                               "linear": _linear}
#: The parameters that each model takes by name; others are an error.
PARAMS: dict[str, frozenset] = {
    "logistic": frozenset({"C", "penalty", "max_iter"}),
    "knn": frozenset({"n_neighbors", "weights", "p"}),
    "svm": frozenset({"C", "kernel", "gamma", "degree"}),
    "tree": frozenset({"criterion", "max_depth", "min_samples_split", "min_samples_leaf"}),
    "forest": frozenset({"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "seed"}),
    "nb": frozenset({"model_type", "alpha"}),
    "linear": frozenset(),
}


def _known(name: str, params: dict) -> str:
    """The model's key; unknown parameters are an error."""
    key = name.strip().lower()
    if key not in MODELS:
        raise ValueError(f"unsupported model_type {name!r}; choose one of {sorted(MODELS)}")
    unknown = sorted(set(params) - PARAMS[key])
    if unknown:
        raise ValueError(f"{key} takes no parameter {', '.join(unknown)}; "
                         f"choose among {sorted(PARAMS[key])}")
    return key


def get_model(name: str) -> Callable:
    fit = MODELS[_known(name, {})]

    def model(train, test, features, label, id, keep=(), proba=False, **params):
        """Predictions of ``test``: id, label, ``keep``, prediction, p_<class> where there are any."""
        _known(name, params)
        return fit(train, test, features, label, id, [label, *keep], proba, **params)

    return model


# ---- folds ------------------------------------------------------------------------------
def kfold(df: DataFrame, cv: int, id: str = "id") -> DataFrame:
    """Unshuffled k-fold: contiguous id blocks, the first n % cv folds one larger."""
    n = df.count()
    if cv < 2 or cv > n:
        raise ValueError(f"cv={cv} needs 2 <= cv <= n ({n})")
    base, extra = divmod(n, cv)
    bounds = np.cumsum([base + (1 if f < extra else 0) for f in range(cv)])
    r = global_rank(df, [F.col(id)], "_r")
    fold = sum((F.when(F.col("_r") >= int(b), 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    return r.withColumn("fold", fold.cast("int")).drop("_r")


def with_folds(df: DataFrame, label: str, cv: int, id: str, classifier: bool) -> DataFrame:
    return stratified_folds(df, label, cv, id) if classifier else kfold(df, cv, id)


def _is_classifier(model_type: str) -> bool:
    return model_type.strip().lower() != "linear"


def _fold_score(model, data, f, features, label, id, scoring, params):
    tr = data.where(F.col("fold") != f)
    te = data.where(F.col("fold") == f)
    pred = model(tr, te, features, label, id, proba=scoring == "roc_auc", **params)
    return metrics.score(pred, scoring, label).first()["score"]


# ---- many problems in one pass ---------------------------------------------------------
def _members(data: DataFrame, cv: int) -> DataFrame:
    """``_at``: for each fold -1 in its test rows, 0 in its training rows."""
    return data.withColumn("_at", F.array(*[F.when(F.col("fold") == f, -1).otherwise(0).cast("bigint")
                                            for f in range(cv)]))


def _positions(data: DataFrame, cv: int, id: str) -> DataFrame:
    """``_at``: for each fold -1 in its test rows, the place by id among its training rows; one ranking for all."""
    r = global_rank(data, [F.col(id)], "_g",
                    sums={f"_s{f}": (F.col("fold") == f).cast("bigint") for f in range(cv)})
    at = F.array(*[F.when(F.col("fold") == f, F.lit(-1).cast("bigint")).otherwise(F.col("_g") - F.col(f"_s{f}"))
                   for f in range(cv)])
    return r.select(*data.columns, at.alias("_at"))


def _knn_problems(data, features, label, id, cands, sizes, cv, train):
    from .neighbors import knn_problems
    by_p = {}
    for c, q in enumerate(cands):
        weights = str(q.get("weights", "uniform"))
        if weights not in ("uniform", "distance"):
            raise ValueError("weights must be 'uniform' or 'distance'")
        by_p.setdefault(float(q.get("p", 2)), []).append((c, int(q.get("n_neighbors", 5)), weights == "distance"))
    problem, tables = ["q", "part", "size", "seen", "cand"], []
    first = lambda votes: F.min_by("lab", F.struct(-F.col(votes), F.col("lab")))
    for p, some in by_p.items():
        near = knn_problems(data, features, label, max(k for _, k, _ in some), sizes, cv, "_at", p, id, train)
        each = F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(k).alias("k"), F.lit(w).alias("near"))
                         for c, k, w in some])
        votes = (near.select("q", "part", "size", "seen", "y", "lab", "dist", "rank", F.explode(each).alias("c"))
                 .select("*", "c.*").where(F.col("rank") <= F.col("k")))
        weight = F.when(~F.col("near"), 1.0).when(F.col("dist") > 0, 1.0 / F.col("dist")).otherwise(0.0)
        ballot = votes.groupBy(*problem, "lab").agg(
            F.first("y").alias("y"), F.first("near").alias("near"), F.count_if(F.col("dist") == 0).alias("zero"),
            F.sum(weight).alias("votes"))
        tables.append(ballot.groupBy(*problem).agg(
            F.first("y").alias("y"),
            F.when(F.first("near") & (F.max("zero") > 0), first("zero")).otherwise(first("votes")).alias("prediction")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _nb_problems(data, features, label, id, cands, sizes, cv, train):
    from . import bayes
    models = bayes.fit_problems(data, features, label, cands, sizes, cv, "_at")
    return bayes.predict_problems(models, data, label, sizes, "_at", train)


def _svm_problems(data, features, label, id, cands, sizes, cv, train):
    from . import svm
    out = None
    for (c, f), model in svm.fit_problems(data, features, label, cands, cv, "_at", id).items():
        test = data.where(F.col("_at")[f] < 0)
        pred = model.predict(test, id, keep=[label], proba=False).select(
            F.lit(c).alias("cand"), F.lit(f).alias("part"), F.lit(0).alias("size"), F.lit(False).alias("seen"),
            F.col(label).alias("y"), "prediction")
        out = pred if out is None else out.unionByName(pred)
    return out


#: Models whose problems share their statistics: functions of a table with ``_at`` to
#: (cand, part, size, seen, y, prediction); ``seen`` marks training rows.
SHARED: dict[str, Callable] = {"knn": _knn_problems, "nb": _nb_problems, "svm": _svm_problems}
#: Those that take several training sizes.
SIZED = ("knn", "nb")


def _fold_scores(data, features, label, id, model_type, cands, cv, scoring) -> dict[tuple[int, int], float]:
    """The score of each (candidate, fold)."""
    for q in cands:
        key = _known(model_type, q)
    if key in SHARED and scoring.strip().lower() != "roc_auc":
        pred = SHARED[key](_members(data, cv), features, label, id, cands, [1], cv, False)
        scored = metrics.score(pred, scoring, "y", keys=("cand", "part"))
        return {(r["cand"], r["part"]): r["score"] for r in scored.collect()}      # candidates x folds
    model = get_model(model_type)
    jobs = [(c, f) for c in range(len(cands)) for f in range(cv)]
    with ThreadPoolExecutor(PARALLEL_FITS) as ex:
        return dict(zip(jobs, ex.map(lambda cf: _fold_score(model, data, cf[1], features, label, id, scoring,
                                                            cands[cf[0]]), jobs), strict=True))


# ---- cross validation (E6, E7) -------------------------------------------------------------
def cross_validate(df: DataFrame, features: Sequence[str], label: str,
                   model_type: str = "logistic", cv: int = 5, scoring: str = "accuracy",
                   id: str = "id", params: dict | None = None) -> DataFrame:
    """(fold, score, n_train, n_test) -- one row per fold."""
    features = list(features)
    check_columns(df, [id, label] + features)
    _known(model_type, params or {})
    spark = df.sparkSession
    data = with_folds(df.select(id, label, *features), label, cv, id,
                      _is_classifier(model_type)).persist()
    sizes = {r["fold"]: r["n"] for r in
             data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # cv rows
    n = sum(sizes.values())
    scores = _fold_scores(data, features, label, id, model_type, [params or {}], cv, scoring)
    data.unpersist()
    return spark.createDataFrame(
        [(f, float(scores[0, f]), n - sizes[f], sizes[f]) for f in range(cv)],
        "fold int, score double, n_train bigint, n_test bigint")


def cv_summary(scores: DataFrame) -> DataFrame:
    """One row: mean, std (population), min, max of the fold scores."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
                      F.min("score").alias("min"), F.max("score").alias("max"))


# ---- grid search (E23, E24) -----------------------------------------------------------
def candidates(grid: dict[str, list]) -> list[dict]:
    """Cartesian product in the reference's order (last parameter varies fastest,
    parameters sorted by name as the library does)."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def grid_search(df: DataFrame, features: Sequence[str], label: str, grid: dict[str, list],
                model_type: str = "svm", cv: int = 5, scoring: str = "accuracy",
                id: str = "id") -> DataFrame:
    """(candidate, params, mean, std, rank, best) -- one row per candidate."""
    features = list(features)
    if not grid:
        raise ValueError("empty parameter grid")
    cands = candidates(grid)
    for q in cands:
        _known(model_type, q)
    spark = df.sparkSession
    data = with_folds(df.select(id, label, *features), label, cv, id,
                      _is_classifier(model_type)).persist()
    scores = _fold_scores(data, features, label, id, model_type, cands, cv, scoring)
    data.unpersist()
    per = np.array([[scores[c, f] for f in range(cv)] for c in range(len(cands))], dtype=float)
    rows = []
    for c, p in enumerate(cands):
        rows.append((c, ", ".join(f"{k}={v}" for k, v in p.items()),
                     float(np.mean(per[c])), float(np.std(per[c]))))
    out = spark.createDataFrame(rows, "candidate int, params string, mean double, std double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("mean").desc_nulls_last(), F.col("candidate"))
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn(
        "best", F.col("rank") == 1)


def best_params(results: DataFrame, grid: dict[str, list]) -> dict:
    """The parameters of the best candidate of ``grid_search``."""
    return candidates(grid)[results.where("best").select("candidate").first()[0]]


def fit_best(df: DataFrame, features: Sequence[str], label: str, results: DataFrame,
             grid: dict[str, list], model_type: str = "svm", id: str = "id") -> Callable:
    """The best candidate refit on all of ``df``: a function from a table to its predictions."""
    model, params = get_model(model_type), best_params(results, grid)
    return lambda rows, keep=(), proba=False: model(
        df, rows, list(features), label, id, keep=keep, proba=proba, **params)


def predict_split(df: DataFrame, features: Sequence[str], label: str, model_type: str = "logistic",
                  id: str = "id", test_size: float = 0.2, seed: int = 42, proba: bool = False,
                  params: dict | None = None) -> DataFrame:
    """Split, fit and predict by model name: the test rows with their predictions.

    Feed the result to ``metrics.classification_report``, ``confusion_matrix``
    or, with ``proba``, to ``roc.curve_points`` on ``p_<class>``.
    """
    parts = cut_lineage(train_test_split(df.select(id, label, *features), id, test_size, seed,
                                         stratify=label if _is_classifier(model_type) else None))
    return get_model(model_type)(
        parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split"),
        list(features), label, id, proba=proba, **(params or {}))


def grid_top(results: DataFrame, n: int = 10) -> DataFrame:
    return results.where(F.col("rank") <= n)


# ---- learning curve (E25, E26) ---------------------------------------------------------
def learning_curve(df: DataFrame, features: Sequence[str], label: str,
                   model_type: str = "logistic", cv: int = 5,
                   train_sizes: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 1.0),
                   id: str = "id", params: dict | None = None) -> DataFrame:
    """(train_size, train_mean, train_std, val_mean, val_std, gap).

    Sizes are int(fraction * size of the first training fold), de-duplicated
    and sorted; each fit uses the first ``size`` rows (id order) of the
    training fold; scores are accuracy.
    """
    features = list(features)
    model = get_model(model_type)
    spark = df.sparkSession
    data = with_folds(df.select(id, label, *features), label, cv, id,
                      _is_classifier(model_type)).persist()
    sizes_f = {r["fold"]: r["n"] for r in
               data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes_f.values())
    n_max = n - sizes_f[0]
    sizes = sorted({int(fr * n_max) if fr <= 1.0 else int(fr) for fr in train_sizes})
    if not sizes or sizes[0] < 1:
        raise ValueError(f"train sizes {sizes} must be at least 1")
    placed = cut_lineage(_positions(data, cv, id))
    key = _known(model_type, params or {})
    hit = F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a")
    if key in SHARED and key in SIZED:
        pred = SHARED[key](placed, features, label, id, [params or {}], sizes, cv, True)
        got = {(r["size"], r["part"], r["seen"]): r["a"]
               for r in pred.groupBy("size", "part", "seen").agg(hit).collect()}       # sizes x folds x 2
        res = [(s, f, got[i, f, True], got[i, f, False]) for i, s in enumerate(sizes) for f in range(cv)]
    else:
        def one(sf):
            s, f = sf
            at = F.col("_at")[f]
            sub = placed.where((at >= 0) & (at < s))
            # one fit scores both sets; a row is in one of them only
            both = placed.where(at < s).withColumn("_seen", at >= 0)
            pred = model(sub, both, features, label, id, keep=["_seen"], **(params or {}))
            got = {r["_seen"]: r["a"] for r in pred.withColumnRenamed(label, "y").groupBy("_seen").agg(hit).collect()}
            return s, f, got[True], got[False]

        jobs = [(s, f) for s in sizes for f in range(cv)]
        with ThreadPoolExecutor(PARALLEL_FITS) as ex:
            res = list(ex.map(one, jobs))
    data.unpersist()
    rows = []
    for s in sizes:
        tr = np.array([r[2] for r in res if r[0] == s])
        va = np.array([r[3] for r in res if r[0] == s])
        rows.append((s, float(tr.mean()), float(tr.std()), float(va.mean()), float(va.std()),
                     float(tr.mean() - va.mean())))
    return spark.createDataFrame(rows, "train_size int, train_mean double, train_std double, "
                                       "val_mean double, val_std double, gap double")


def fit_diagnosis(curve: DataFrame) -> DataFrame:
    """One row: status (underfit / overfit / good), more_data_helps, final scores."""
    from pyspark.sql import Window
    w = Window.orderBy("train_size")
    c = curve.select("*", F.row_number().over(w).alias("_i"),
                     F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    agg = c.agg(F.max(F.when(F.col("_i") == F.col("_n"), F.col("val_mean"))).alias("final_val"),
                F.max(F.when(F.col("_i") == F.col("_n"), F.col("train_mean"))).alias("final_train"),
                F.max(F.when(F.col("_i") == 1, F.col("val_mean"))).alias("first_val"),
                F.max("_n").alias("_n"))
    gap = F.col("final_train") - F.col("final_val")
    status = (F.when(F.col("final_val") < 0.7, "underfit").when(gap > 0.15, "overfit")
              .otherwise("good"))
    helps = (F.col("_n") >= 2) & (F.col("final_val") - F.col("first_val") > 0.05)
    return agg.select(status.alias("status"), helps.alias("more_data_helps"),
                      F.col("final_train"), F.col("final_val"), gap.alias("gap"))
