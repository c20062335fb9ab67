"""Exact quantiles and modes without per-group value maps.

``percentile`` / ``median`` / ``mode`` aggregates keep a map of every
distinct value in one aggregation buffer -- unbounded at scale.  Here:

* quantiles (linear interpolation, as ``quantile_cont``): unpivot to
  (pos, value), count equal values (so that a hot value is one row), add up
  the counts in order with ``global_rank``, and pick the two order statistics
  around (n - 1) * q for each feature;
* mode (ties -> smallest value): ``groupBy(pos, value).count()`` (partial
  aggregation) then a ``min_by`` per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import as_double
from .rank import global_rank


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(j).alias("pos"), as_double(c).alias("v")) for j, c in enumerate(cols)]))
    ).where(F.col("v").isNotNull())


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]
                    ) -> list[list[float | None]]:
    """[[q values] per column]; None for a column with no value."""
    cols = list(cols)
    values = _long(df, cols).groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    r = global_rank(values, [F.col("pos"), F.col("v")], "_r", sums={"_end": F.col("n")})
    counts = {x["pos"]: x["n"] for x in
              r.groupBy("pos").agg(F.sum("n").alias("n")).collect()}   # p rows
    start, acc = {}, 0
    for j in range(len(cols)):
        start[j] = acc
        acc += counts.get(j, 0)
    wanted = set()
    plan = {}
    for j in range(len(cols)):
        n = counts.get(j, 0)
        for q in qs:
            if n == 0:
                plan[(j, q)] = None
                continue
            h = (n - 1) * q
            lo, hi = math.floor(h), math.ceil(h)
            plan[(j, q)] = (start[j] + lo, start[j] + hi, h - lo)
            wanted.update({start[j] + lo, start[j] + hi})
    got = {}
    if wanted:
        # each wanted place lies in exactly one run of equal values
        place = F.explode(F.filter(F.array(*[F.lit(w) for w in sorted(wanted)]), lambda g: (
            g < F.col("_end")) & (g >= F.col("_end") - F.col("n"))))
        got = {x["_g"]: x["v"] for x in r.select("v", place.alias("_g")).collect()}
    out = []
    for j in range(len(cols)):
        row = []
        for q in qs:
            p = plan[(j, q)]
            if p is None:
                row.append(None)
            else:
                a, b, frac = got[p[0]], got[p[1]], p[2]
                row.append(a + (b - a) * frac if frac else a)
        out.append(row)
    return out


def modes(df: DataFrame, cols: Sequence[str]) -> list[float | None]:
    """Most frequent value per column; ties -> the smallest value."""
    cols = list(cols)
    cnt = _long(df, cols).groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    best = {r["pos"]: r["m"] for r in cnt.groupBy("pos").agg(
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).collect()}
    return [best.get(j) for j in range(len(cols))]
