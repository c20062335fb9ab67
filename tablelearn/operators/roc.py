"""ROC curve, AUC, best threshold and key points for binary scores.

Scores are first grouped (one row per distinct score, partial aggregation),
then cumulative positive/negative counts in descending score order come from
the distributed ``global_rank`` (range partitioning + per-partition offsets),
and the neighbour needed by the collinear-point filter is an equi-join on the
rank (rank + 1), not a single-partition ``lag`` window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from ..session import cut_lineage

INF = float("inf")


def _grouped(scored: DataFrame, label: str, score: str, positive) -> DataFrame:
    y = (F.col(label) == F.lit(positive)).cast("bigint")
    return scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve_points(scored: DataFrame, label: str = "label", score: str = "score",
                 positive=1, drop_intermediate: bool = True) -> DataFrame:
    """(point, threshold, fpr, tpr, j) -- point 0 is the (0, 0) start at +inf."""
    g = _grouped(scored, label, score, positive)
    r = global_rank(g, [-F.col("threshold")], "r",
                    sums={"tps": F.col("pos"), "fps": F.col("neg")})
    r = cut_lineage(r)
    tot = r.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.count(F.lit(1)).alias("m")).first()
    P, N, m = tot["P"], tot["N"], tot["m"]
    if not P or not N:
        raise ValueError("ROC needs both classes in the scored rows")
    if drop_intermediate and m > 2:
        nxt = r.select((F.col("r") - 1).alias("r"), F.col("pos").alias("_np"),
                       F.col("neg").alias("_nn"))
        r = r.join(nxt, "r", "left")
        keep = ((F.col("r") == 0) | (F.col("r") == m - 1)
                | (F.col("_np") != F.col("pos")) | (F.col("_nn") != F.col("neg")))
        r = r.where(keep)
    r = global_rank(r.select("threshold", "tps", "fps"), [-F.col("threshold")], "k")
    pts = r.select((F.col("k") + 1).alias("point"), "threshold",
                   (F.col("fps") / F.lit(float(N))).alias("fpr"),
                   (F.col("tps") / F.lit(float(P))).alias("tpr"))
    start = scored.sparkSession.createDataFrame(
        [(0, INF, 0.0, 0.0)], "point long, threshold double, fpr double, tpr double")
    out = start.unionByName(pts)
    return out.select(F.col("point").cast("bigint").alias("point"), "threshold", "fpr", "tpr",
                      (F.col("tpr") - F.col("fpr")).alias("j"))


def auc(scored: DataFrame, label: str = "label", score: str = "score",
        positive=1) -> DataFrame:
    """One row: auc (trapezoid over the full curve), n_pos, n_neg.

    Each distinct score contributes neg * (2 * tps - pos) / (2 P N): an
    aggregate after the cumulative sums, no neighbour rows needed.
    """
    g = _grouped(scored, label, score, positive)
    r = global_rank(g, [-F.col("threshold")], "r", sums={"tps": F.col("pos")})
    a = r.agg(F.sum(F.col("neg").cast("decimal(19,0)") * (
              2 * F.col("tps") - F.col("pos")).cast("decimal(19,0)")).alias("_s"),
              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select((F.col("_s").cast("double")
                     / (2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
                    .alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"),
                    F.col("n_neg").cast("bigint").alias("n_neg"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The first point with the largest Youden J = tpr - fpr."""
    best = curve.agg(F.min_by(F.struct("point", "threshold", "fpr", "tpr", "j"),
                              F.struct(-F.col("j"), F.col("point"))).alias("b"))
    return best.select("b.*")


def key_points(curve: DataFrame) -> DataFrame:
    """Every ``max(1, n // min(15, n))``-th point of the curve, from point 0."""
    n = curve.count()
    step = max(1, n // min(15, n))
    return curve.where(F.col("point") % step == 0)


def auc_band(auc_col) -> F.Column:
    a = F.col(auc_col) if isinstance(auc_col, str) else auc_col
    return (F.when(a >= 0.9, "excellent").when(a >= 0.8, "good")
            .when(a >= 0.7, "fair").when(a >= 0.5, "poor").otherwise("worse than random"))
