"""Missing-value imputation and missing statistics.

Column statistics come from one aggregate; the fill values (p numbers) are
inlined as literals in a ``coalesce`` projection.  A column with no present
value keeps NULL and is flagged by ``missing_stats`` (``all_missing``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_numeric
from ..functions.quantile import exact_quantiles, modes

STRATEGIES = ("mean", "median", "most_frequent", "constant")


@dataclass
class ImputerModel:
    strategy: str
    features: list[str]
    fill: list[float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(as_double(c), F.lit(v).cast("double")).alias(c)
                  for c, v in zip(self.features, self.fill)}
        return df.select(*[filled.get(c, F.col(c)) for c in df.columns])

    def params(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, c, v) for i, (c, v) in enumerate(zip(self.features, self.fill))],
            "pos int, feature string, fill double")


def fit(df: DataFrame, features: Sequence[str], strategy: str = "mean",
        fill_value: float = 0.0, exact: bool = True) -> ImputerModel:
    strategy = strategy.strip().lower()
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {STRATEGIES}")
    features = list(features)
    check_numeric(df, features)
    if strategy == "constant":
        return ImputerModel(strategy, features, [float(fill_value)] * len(features))
    if strategy == "median" and exact:
        # distributed exact median (no per-value map in one aggregation buffer)
        q = exact_quantiles(df, features, [0.5])
        return ImputerModel(strategy, features, [v[0] for v in q])
    if strategy == "most_frequent":
        # grouped counts per (feature, value); ties -> the smallest value
        return ImputerModel(strategy, features, modes(df, features))
    aggs = []
    for i, c in enumerate(features):
        x = as_double(c)
        if strategy == "mean":
            aggs.append(F.avg(x).alias(f"a{i}"))
        else:
            aggs.append(F.percentile_approx(x, 0.5, 100000).alias(f"a{i}"))
    row = df.agg(*aggs).first()
    return ImputerModel(strategy, features, [row[f"a{i}"] for i in range(len(features))])


def impute(df: DataFrame, features: Sequence[str], strategy: str = "mean",
           fill_value: float = 0.0) -> DataFrame:
    return fit(df, features, strategy, fill_value).transform(df)


def missing_stats(df: DataFrame, features: Sequence[str],
                  model: ImputerModel | None = None) -> DataFrame:
    """Per feature: missing, total, percent, all_missing, fill (if a model)."""
    features = list(features)
    check_numeric(df, features)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.when(as_double(c).isNull(), 1).otherwise(0)).alias(f"m{i}")
        for i, c in enumerate(features)])
    fill = model.fill if model else [None] * len(features)
    rows = F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                 F.col(f"m{i}").cast("bigint").alias("missing"),
                 F.col("_n").cast("bigint").alias("total"),
                 F.lit(fill[i]).cast("double").alias("fill"))
        for i, c in enumerate(features)]))
    out = agg.select(rows)
    return out.select(
        "pos", "feature", "missing", "total",
        F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total"))
         .cast("double").alias("percent"),
        (F.col("missing") == F.col("total")).alias("all_missing"),
        "fill")
