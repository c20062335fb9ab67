"""Univariate feature scores (ANOVA F, regression F) and top-k selection.

Scores come from aggregates over the wide frame: one ``groupBy(label)``
(partial aggregation, output = classes x features) for the ANOVA, one
global ``corr`` aggregate for regression.  Nothing per row leaves the
executors; the selected-feature list (p names) drives the projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..session import cut_lineage


def _per_class_long(df, features, label):
    pc = df.groupBy(label).agg(*[
        x for i, c in enumerate(features) for x in (
            F.count(as_double(c)).alias(f"n{i}"), F.avg(as_double(c)).alias(f"m{i}"),
            F.var_pop(as_double(c)).alias(f"v{i}"))])
    return pc.select(F.col(label), F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                 F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                 F.col(f"v{i}").alias("var"))
        for i, c in enumerate(features)])))


def f_classif(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(pos, feature, score): one-way ANOVA F of each feature across classes."""
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [label])
    lf = _per_class_long(df, features, label).where(F.col("n") > 0)
    w = Window.partitionBy("pos")
    tot_n = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / tot_n
    g = lf.select("pos", "feature", "n", "mean", "var",
                  grand.alias("grand"), tot_n.alias("tot"),
                  F.count(F.lit(1)).over(w).alias("k"))
    s = g.groupBy("pos", "feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"),
        F.first("tot").alias("tot"), F.first("k").alias("k"))
    score = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("tot") - F.col("k")))
    return s.select(F.col("pos").cast("int").alias("pos"), "feature",
                    F.when((F.col("ssw") > 0) & (F.col("k") > 1), score)
                     .when((F.col("ssb") > 0) & (F.col("k") > 1), F.lit(float("inf")))
                     .cast("double").alias("score"))


def f_regression(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(pos, feature, score): F = r^2 / (1 - r^2) * (n - 2), r = Pearson."""
    features = list(features)
    check_numeric(df, features + [label])
    y = as_double(label)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.corr(as_double(c), y).alias(f"r{i}") for i, c in enumerate(features)])
    long = agg.select(F.col("_n"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"))
        for i, c in enumerate(features)])))
    r2 = F.col("r") * F.col("r")
    return long.select(F.col("pos").cast("int").alias("pos"), "feature",
                       F.when(r2 < 1, r2 / (1 - r2) * (F.col("_n") - 2))
                        .when(r2 >= 1, F.lit(float("inf")))
                        .cast("double").alias("score"))


def k_best(scores: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` (1 = best; score desc, NULL last, pos asc) and ``selected``.

    ``scores`` holds one row per feature, so the ordering window is small.
    """
    w = Window.orderBy(F.col("score").desc_nulls_last(), F.col("pos"))
    r = F.row_number().over(w)
    return scores.select("pos", "feature", "score", r.cast("bigint").alias("rank"),
                         (r <= F.lit(k)).alias("selected"))


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int = 5,
                  method: str = "f_classif", id: str = "id"):
    """Returns (scores with selected flag, projected data)."""
    features = list(features)
    k = min(k, len(features))
    if method == "f_classif":
        sc = f_classif(df, features, label)
    elif method == "f_regression":
        sc = f_regression(df, features, label)
    elif method in ("mutual_info_classif", "mutual_info_regression"):
        from . import mutual_info
        sc = (mutual_info.mi_classif(df, features, label, id=id)
              if method == "mutual_info_classif"
              else mutual_info.mi_regression(df, features, label, id=id))
    else:
        raise ValueError(f"unknown method {method!r}")
    ranked = cut_lineage(k_best(sc, k))
    keep = [r["feature"] for r in ranked.where("selected").orderBy("pos").collect()]
    return ranked, df.select(id, *keep)


def rfe(df: DataFrame, features: Sequence[str], label: str, k: int = 5, C: float = 1.0,
        max_iter: int = 1000) -> DataFrame:
    """Recursive feature elimination with logistic regression (step 1).

    Each round refits on the remaining features (one Spark aggregate per
    Newton step over the cached table) and drops the feature with the
    smallest squared coefficient summed over classes (ties -> later position).
    (pos, feature, rank, selected): rank 1 = kept, larger = dropped earlier.
    """
    from . import logistic
    features = list(features)
    k = max(1, min(k, len(features)))
    data = df.select(label, *[as_double(c).alias(c) for c in features]).persist()
    remaining = list(features)
    rank = {}
    while len(remaining) > k:
        m = logistic.fit(data, remaining, label, C=C, max_iter=max_iter)
        imp = (np.asarray(m.coef) ** 2).sum(axis=0)
        worst = min(range(len(remaining)), key=lambda i: (imp[i], -i))
        rank[remaining[worst]] = len(remaining) - k + 1
        remaining.pop(worst)
    data.unpersist()
    for c in remaining:
        rank[c] = 1
    spark = df.sparkSession
    return spark.createDataFrame(
        [(i, c, int(rank[c]), rank[c] == 1) for i, c in enumerate(features)],
        "pos int, feature string, rank int, selected boolean")
