"""Feature importance ranking: rank, share, cumulative share, 90 % / 95 % counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(imp: DataFrame) -> DataFrame:
    """(pos, feature, importance, rank, share, cumulative, n_for_90, n_for_95).

    ``imp`` has one row per feature (p rows), so the ordering window is small.
    Shares are importance / total, so the 90 % / 95 % counts are meaningful
    for any non-negative importance (coefficient magnitudes included).
    """
    w = Window.orderBy(F.col("importance").desc(), F.col("pos"))
    tot = F.sum("importance").over(Window.partitionBy())
    r = imp.select("pos", "feature", "importance",
                   F.row_number().over(w).cast("bigint").alias("rank"),
                   (F.col("importance") / tot).alias("share"))
    r = r.withColumn("cumulative", F.sum("share").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    allw = Window.partitionBy()
    n90 = F.min(F.when(F.col("cumulative") >= 0.9 - 1e-12, F.col("rank"))).over(allw)
    n95 = F.min(F.when(F.col("cumulative") >= 0.95 - 1e-12, F.col("rank"))).over(allw)
    return r.select("*", n90.alias("n_for_90"), n95.alias("n_for_95"))
