"""Mutual-information feature scores with the k-NN estimators.

* ``mi_classif`` (continuous feature, discrete label; Ross 2014): per point the
  radius r = distance to the k-th nearest same-label point, m = number of all
  points strictly within r (self included); MI = psi(n) + <psi(k)> -
  <psi(n_label)> - <psi(m)>, clipped at 0; points of singleton labels are
  ignored.
* ``mi_regression`` (continuous feature, continuous target; Kraskov 2004,
  Chebyshev): r = k-th neighbour distance in the joint (x, y) space (exact
  blocked k-NN), n_x / n_y = points strictly within r on each axis (self
  excluded); MI = psi(n) + psi(k) - <psi(n_x + 1)> - <psi(n_y + 1)>.

Everything is distributed: neighbours along one axis are those at the rank
offsets up to k (1-D: the k nearest same-label points are among the k before
and k after in sorted order), read by windows over chunks of ranks that hold
the k rows before and after them too, and "how many values lie strictly within r" is a
cumulative count over data values merged with +-r marker rows, both from the
bucketed ``global_rank`` -- no window over a whole feature or label.  No
random jitter is added (the library adds 1e-10 noise); ties are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.rank import global_rank, maybe_broadcast
from ..session import cut_lineage

SHRINK = 1e-12
CHUNK = 4096         # ranks that a window holds


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1: recurrence up by 6, then the asymptotic series."""
    shift = sum((F.lit(1.0) / (x + F.lit(float(j))) for j in range(6)), F.lit(0.0))
    z = x + F.lit(6.0)
    z2 = z * z
    asym = (F.log(z) - F.lit(0.5) / z - F.lit(1.0 / 12) / z2 + F.lit(1.0 / 120) / (z2 * z2)
            - F.lit(1.0 / 252) / (z2 * z2 * z2) + F.lit(1.0 / 240) / (z2 * z2 * z2 * z2))
    return asym - shift


def _long(df, features, id, extra):
    return df.select(F.col(id).alias("_id"), *[F.col(e) for e in extra], F.inline(F.array(*[
        F.struct(F.lit(j).alias("pos"), as_double(c).alias("x")) for j, c in enumerate(features)])))


def _count_within(points: DataFrame, values: DataFrame, strict_self: bool) -> DataFrame:
    """For points (pos, _id, x, r): m = #values v of the same pos with |v - x| < r.

    values: (pos, x); equal ones are counted first.  Gives (pos, _id, m, n, psi),
    n and psi being the number of points and the sum of their ``psi``, if they
    have one.  Marker rows x + r (counts values < x + r) and x - r
    (counts values <= x - r) are merged with the values; a cumulative count of
    value rows in (pos, value, tiebreak) order answers both.
    """
    # strict "< r": shrink r a hair so the k-th neighbour itself (exactly at r)
    # is not counted after x + r rounds (the library shrinks by one ulp)
    points = points.withColumn("r", F.col("r") * F.lit(1.0 - SHRINK))
    psi = F.col("psi") if "psi" in points.columns else F.lit(0.0)
    vals = values.groupBy("pos", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("_isv")).select(
        "pos", "v", "_isv", F.lit(1).alias("_t"), F.lit(None).cast(points.schema["_id"].dataType).alias("_id"),
        F.lit(None).cast("int").alias("_side"), F.lit(None).cast("double").alias("psi"))
    # r == 0 (duplicates): count the exact duplicates, as "<= nextafter(0)" does
    hi = points.select("pos", (F.col("x") + F.col("r")).alias("v"), F.lit(0).cast("bigint").alias("_isv"),
                       F.when(F.col("r") == 0, 2).otherwise(0).alias("_t"), "_id",
                       F.lit(1).alias("_side"), psi.alias("psi"))
    lo = points.select("pos", (F.col("x") - F.col("r")).alias("v"), F.lit(0).cast("bigint").alias("_isv"),
                       F.when(F.col("r") == 0, 0).otherwise(2).alias("_t"), "_id",
                       F.lit(0).alias("_side"), F.lit(None).cast("double").alias("psi"))
    u = vals.unionByName(hi).unionByName(lo)
    r = global_rank(u, [F.col("pos"), F.col("v"), F.col("_t"),
                        F.col("_id")],
                    "_g", sums={"_c": F.col("_isv")})
    start = r.groupBy("pos").agg(F.min(F.col("_c") - F.col("_isv")).alias("_c0"))
    r = r.join(F.broadcast(start), "pos").where(F.col("_isv") == 0)
    cnt = (F.col("_c") - F.col("_c0"))
    return r.groupBy("pos", "_id").agg(
        F.sum(F.when(F.col("_side") == 1, cnt).otherwise(-cnt)).alias("m"),
        F.sum("_side").alias("n"), F.sum("psi").alias("psi"))


def _radii(ranked: DataFrame, k: int) -> DataFrame:
    """(pos, _y, _id, x, _nl, r): distance to the min(k, _nl - 1)-th nearest row of the same pos and label.

    ``ranked`` has those columns and ``_g``, the row's place by (pos, label, x, id).  A row that is
    there several times is one point with the neighbours of all of its copies.
    """
    size = max(CHUNK, k)
    chunk, at = F.floor(F.col("_g") / size), F.col("_g") % size
    places = F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")),
                     F.when(at < k, F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own"))),
                     F.when(at >= size - k, F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))))
    spread = ranked.select("pos", "_y", "_id", "x", "_nl", "_g", F.inline(F.filter(places, lambda p: p.isNotNull())))
    w = Window.partitionBy("chunk").orderBy("_g")
    row = F.struct("pos", "_y", "x", "_id")
    sides = [side(row, j).over(w) for j in range(1, k + 1) for side in (F.lag, F.lead)]
    akin = lambda o: (o["pos"] == F.col("pos")) & (o["_y"] == F.col("_y"))
    twin = F.lit(False)
    for o in sides[:2]:
        twin = twin | F.coalesce(akin(o) & o["x"].eqNullSafe(F.col("x")) & o["_id"].eqNullSafe(F.col("_id")),
                                 F.lit(False))
    gaps = F.array(*[F.when(akin(o), F.abs(F.col("x") - o["x"])) for o in sides])
    near = spread.select("pos", "_y", "_id", "x", "_nl", "own", twin.alias("_twin"), gaps.alias("_ds")).where("own")
    point, kth = ["pos", "_y", "_id", "x", "_nl"], F.least(F.lit(k), F.col("_nl") - 1).cast("int")
    near = near.withColumn("_ds", F.sort_array(F.filter("_ds", lambda v: v.isNotNull())))
    near = cut_lineage(near.select(*point, F.when(F.col("_twin"), F.col("_ds")).alias("_ds"),
                                   F.when(~F.col("_twin"), F.element_at("_ds", kth)).alias("r")))
    many = near.where(F.col("_ds").isNotNull()).groupBy(*point).agg(
        F.sort_array(F.flatten(F.collect_list("_ds"))).alias("_ds"))
    return near.where(F.col("_ds").isNull()).select(*point, "r").unionByName(
        many.select(*point, F.element_at("_ds", kth).alias("r")))


def mi_classif(df: DataFrame, features: Sequence[str], label: str, k: int = 3,
               id: str = "id") -> DataFrame:
    """(pos, feature, score)."""
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [id, label])
    lf = _long(df, features, id, [label]).withColumnRenamed(label, "_y")
    lf = cut_lineage(lf)
    cnt = lf.groupBy("pos", "_y").agg(F.count(F.lit(1)).alias("_nl"))
    ncls = cnt.count()
    lf2 = lf.join(maybe_broadcast(cnt, ncls), ["pos", "_y"]).where(F.col("_nl") > 1)
    # rank inside (pos, label) by value, neighbours at rank +- j
    r = global_rank(lf2, [F.col("pos"), F.col("_y").cast("string"), F.col("x"), F.col("_id")],
                    "_g")
    rad = _radii(r, k)
    psi = digamma(F.least(F.lit(k), F.col("_nl") - 1).cast("double")) - digamma(F.col("_nl").cast("double"))
    m = _count_within(rad.select("pos", "_id", "x", "r", psi.alias("psi")), lf2.select("pos", "x"), True)
    s = m.where(F.col("_id").isNotNull()).groupBy("pos").agg(
        F.sum("n").alias("_n"), F.sum("psi").alias("_pk"),
        F.sum(F.col("n") * digamma(F.col("m").cast("double"))).alias("_pm"))
    mi = digamma(F.col("_n").cast("double")) + (F.col("_pk") - F.col("_pm")) / F.col("_n")
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "pos int, feature string")
    out = names.join(s, "pos", "left").select(
        F.col("pos").cast("int").alias("pos"), "feature",
        F.coalesce(F.greatest(mi, F.lit(0.0)), F.lit(0.0)).alias("score"))
    return out


def mi_regression(df: DataFrame, features: Sequence[str], label: str, k: int = 3,
                  id: str = "id") -> DataFrame:
    """(pos, feature, score) with the Kraskov estimator per feature."""
    from .neighbors import knn
    features = list(features)
    check_numeric(df, features + [label])
    spark = df.sparkSession
    rows = []
    base = df.select(F.col(id).alias("_id"), as_double(label).alias("_t"),
                     *[as_double(c).alias(f"_f{j}") for j, c in enumerate(features)])
    base = cut_lineage(base)
    n = base.count()
    outs = []
    for j, c in enumerate(features):
        xy = base.select("_id", F.col(f"_f{j}").alias("x"), F.col("_t").alias("y"))
        nb = knn(xy, xy, ["x", "y"], k + 1, float("inf"), "_id", "_id")
        # k+1 neighbours include the point itself at distance 0
        rad = (nb.where(F.col("rank") == k + 1).select(F.col("q").alias("_id"),
                                                        F.col("dist").alias("r")))
        pts = xy.join(rad, "_id")
        mx = _count_within(pts.select(F.lit(j).alias("pos"), "_id", "x", "r"),
                           xy.select(F.lit(j).alias("pos"), "x"), True)
        my = _count_within(pts.select(F.lit(j).alias("pos"), "_id", F.col("y").alias("x"), "r"),
                           xy.select(F.lit(j).alias("pos"), F.col("y").alias("x")), True)
        s = (mx.select("pos", "_id", F.col("m").alias("nx")).join(my.select("pos", "_id", F.col("m").alias("ny")),
                                                                  ["pos", "_id"])
             .agg(F.avg(digamma(F.col("nx").cast("double"))).alias("_px"),
                  F.avg(digamma(F.col("ny").cast("double"))).alias("_py")))
        outs.append(s.select(F.lit(j).alias("pos"), F.lit(c).alias("feature"),
                             F.greatest(digamma(F.lit(float(n))) + digamma(F.lit(float(k)))
                                        - F.col("_px") - F.col("_py"), F.lit(0.0))
                             .alias("score")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.select(F.col("pos").cast("int").alias("pos"), "feature", "score")
