"""Feature scaling (standard, minmax, maxabs, robust).

Fit is one global aggregate (partial aggregation on every partition, one
tiny final merge); the fitted parameters are p rows and are inlined into the
projection as literals, so transform is a pure narrow ``select`` that stays
inside whole-stage codegen -- no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_numeric
from ..functions.quantile import exact_quantiles

METHODS = ("standard", "minmax", "maxabs", "robust")


@dataclass
class ScalerModel:
    method: str
    features: list[str]
    center: list[float]
    scale: list[float]
    stats: list[dict]

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Scaled feature columns; other columns pass through unchanged."""
        scaled = {}
        for c, m, s in zip(self.features, self.center, self.scale):
            e = as_double(c)
            if m is not None:
                e = e - F.lit(m)
            scaled[c] = (e / F.lit(s)).alias(c)
        cols = keep if keep is not None else df.columns
        return df.select(*[scaled.get(c, F.col(c)) for c in cols])

    def params(self, spark: SparkSession) -> DataFrame:
        """Fitted table: pos, feature, method, center, scale and raw stats."""
        rows = [(i, c, self.method, self.center[i], self.scale[i],
                 st.get("mean"), st.get("std"), st.get("min"), st.get("max"),
                 st.get("max_abs"), st.get("q25"), st.get("median"), st.get("q75"))
                for i, (c, st) in enumerate(zip(self.features, self.stats))]
        return spark.createDataFrame(
            rows, "pos int, feature string, method string, center double, scale double, "
                  "mean double, std double, min double, max double, max_abs double, "
                  "q25 double, median double, q75 double")


def _nonzero(x):
    # a zero spread maps to scale 1 (the column is only shifted)
    return 1.0 if x is None or x == 0.0 else float(x)


def fit(df: DataFrame, features: Sequence[str], method: str = "standard",
        exact: bool = True, accuracy: int = 100000) -> ScalerModel:
    """Fit a scaler with a single aggregate over ``df``.

    ``robust`` uses exact linear-interpolated quantiles by default; pass
    ``exact=False`` for ``percentile_approx`` (bounded memory per group on
    very large tables).
    """
    method = method.strip().lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")
    features = list(features)
    check_numeric(df, features)
    aggs = []
    for i, c in enumerate(features):
        x = as_double(c)
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif method == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        elif method == "maxabs":
            aggs += [F.max(F.abs(x)).alias(f"a{i}")]
        elif not exact:
            aggs += [F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"a{i}")]
    if method == "robust" and exact:
        # distributed exact quartiles (see functions.quantile)
        qv = exact_quantiles(df, features, [0.25, 0.5, 0.75])
        row = {f"a{i}": qv[i] if qv[i][0] is not None else None for i in range(len(features))}
    else:
        row = df.agg(*aggs).first()
    center, scale, stats = [], [], []
    for i, _ in enumerate(features):
        if method == "standard":
            m, s = row[f"a{i}"], row[f"b{i}"]
            center.append(m); scale.append(_nonzero(s)); stats.append({"mean": m, "std": s})
        elif method == "minmax":
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            rng = None if lo is None else hi - lo
            center.append(lo); scale.append(_nonzero(rng)); stats.append({"min": lo, "max": hi})
        elif method == "maxabs":
            ma = row[f"a{i}"]
            center.append(None); scale.append(_nonzero(ma)); stats.append({"max_abs": ma})
        else:
            q = row[f"a{i}"] or [None, None, None]
            iqr = None if q[0] is None else q[2] - q[0]
            center.append(q[1]); scale.append(_nonzero(iqr))
            stats.append({"q25": q[0], "median": q[1], "q75": q[2]})
    return ScalerModel(method, features, center, scale, stats)


def scale(df: DataFrame, features: Sequence[str], method: str = "standard",
          **kw) -> DataFrame:
    """Fit and transform in one call (the reference's ``preprocess_data``)."""
    return fit(df, features, method, **kw).transform(df)
