"""k-nearest-neighbour classifier and imputer on top of ``neighbors.knn``."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import as_double, check_columns, check_numeric
from .neighbors import knn
from ..session import cut_lineage
from ..session import ship_package

SEARCHES = 32                 # neighbour searches of one imputation, at most
SMALL_PAIRS = 1 << 24         # of rows, that are compared by blocks
FAR = 1e150

def classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
             k: int = 5, weights: str = "uniform", p: float = 2.0, id: str = "id",
             test_id: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., prediction, p_<class>...).

    uniform: majority vote, proba = vote share; distance: weights 1/d, and if
    any neighbour is at distance 0 only those vote.  Ties -> smallest class.
    """
    features = list(features)
    check_numeric(train, features)
    check_columns(train, [id, label])
    test_id = test_id or id
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    nb = knn(test, train.withColumnRenamed(label, "_lab"), features, k, p, test_id, id,
             payload=["_lab"])
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("q"))
        w = F.when(zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(
            1.0 / F.col("dist"))
    votes = nb.withColumn("_w", w).groupBy("q").agg(*[
        F.sum(F.when(F.col("_lab") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"_v{i}")
        for i, c in enumerate(classes)])
    v = [f"_v{i}" for i in range(len(classes))]
    mx = f"greatest({', '.join(v)})" if len(v) > 1 else v[0]
    pick = "CASE " + " ".join(f"WHEN {v[i]} = _mx THEN {i}" for i in range(len(v))) + " END"
    t = votes.select("q", *v, F.expr(mx).alias("_mx"),
                     F.expr(" + ".join(v)).alias("_tot"))
    cls = F.array(*[F.lit(c) for c in classes])
    out = t.select(F.col("q").alias(test_id), cls[F.expr(pick)].alias("prediction"),
                   *[(F.col(v[i]) / F.col("_tot")).alias(f"p_{c}")
                     for i, c in enumerate(classes)])
    if keep:
        out = test.select(test_id, *keep).join(out, test_id)
    return out


def impute_knn(df: DataFrame, features: Sequence[str], id: str = "id", k: int = 5,
               block_rows: int = 2048) -> DataFrame:
    """KNN imputation with the nan-Euclidean distance
    ``sqrt(p / m * sum over the m commonly present features (a - b)^2)``.

    For every (row, missing feature) the donors are rows where that feature
    is present; the fill is the mean of the k nearest donors' values; with no
    donor the column mean.

    Rows whose features are missing alike ask together, and donors that have
    the same features in common with them answer together, by ``neighbors.knn``
    over those features, so that the work grows with the rows.  Small tables,
    those with more than ``SEARCHES`` such groups, and those with values whose
    squares overflow go by blocks, with the same result: each (query block,
    donor block) task emits only the k best donors per missing cell.
    """
    features = list(features)
    check_numeric(df, features)
    nf, k = len(features), int(k)
    ship_package(df.sparkSession)
    x = df.select(F.col(id).alias("_id"),
                  *[as_double(c).alias(f"_x{j}") for j, c in enumerate(features)])
    x = cut_lineage(x)
    mask = F.concat(*[F.when(F.col(f"_x{j}").isNull(), "0").otherwise("1") for j in range(nf)])
    size = F.greatest(*[F.coalesce(F.abs(f"_x{j}"), F.lit(0.0)) for j in range(nf)], F.lit(0.0))
    kinds = x.groupBy(mask.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size")).limit(
        SEARCHES + 1).collect()
    counts = {r["m"]: r["n"] for r in kinds}
    far = any(r["size"] > FAR for r in kinds)
    nr = sum(counts.values())
    nq = nr - counts.get("1" * nf, 0)
    searches = _searches(counts)
    if max(len(counts), len(searches)) > SEARCHES or not searches or far or nq * nr <= SMALL_PAIRS:
        cand = _by_blocks(x, nf, k, block_rows, df.schema[id].dataType)
    else:
        found = [
            knn(x.where(mask == asking), x.where(mask.isin(donors)).withColumn("_v", F.col(f"_x{j}")),
                [f"_x{c}" for c in common], k, 2.0, "_id", "_id", payload=["_v"], of=nf)
            .select("q", F.lit(j).alias("pos"), "r", "dist", F.col("_v").alias("v"))
            for (asking, j, common), donors in searches.items()]
        cand = found[0]
        for t in found[1:]:
            cand = cand.union(t)
    w = Window.partitionBy("q", "pos").orderBy(F.round("dist", 9), F.col("r"))
    fills = (cand.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
             .groupBy("q", "pos").agg(F.avg("v").alias("fill")))
    means = x.agg(*[F.avg(f"_x{j}").alias(f"m{j}") for j in range(nf)]).first()
    wide = fills.groupBy("q").agg(*[F.max(F.when(F.col("pos") == j, F.col("fill")))
                                    .alias(f"_f{j}") for j in range(nf)])
    out = x.join(wide.withColumnRenamed("q", "_id"), "_id", "left")
    res = out.select(F.col("_id").alias(id), *[
        F.coalesce(F.col(f"_x{j}"), F.col(f"_f{j}"), F.lit(means[f"m{j}"]).cast("double"))
        .alias(c) for j, c in enumerate(features)])
    return res


def _searches(masks: Iterable[str]) -> dict[tuple, list[str]]:
    """(mask of the asking rows, missing feature, common features) to the masks of donors; "1" is a present feature."""
    out: dict[tuple, list[str]] = {}
    masks = sorted(masks)
    for asking in masks:
        for j, present in enumerate(asking):
            for donor in masks if present == "0" else ():
                common = tuple(c for c in range(len(asking)) if asking[c] == donor[c] == "1")
                if donor[j] == "1" and common:
                    out.setdefault((asking, j, common), []).append(donor)
    return out


def _by_blocks(x: DataFrame, nf: int, k: int, block_rows: int, id_type: T.DataType) -> DataFrame:
    """(q, pos, r, dist, v): the k nearest donors of each block for each row's missing features."""
    feats = [f"_x{j}" for j in range(nf)]
    miss_any = F.lit(False)
    for c in feats:
        miss_any = miss_any | F.col(c).isNull()
    qry = x.where(miss_any)
    nq, nr = qry.count(), x.count()
    bq, br = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nr / block_rows))
    qs = qry.select("*", F.pmod(F.xxhash64("_id"), F.lit(bq)).cast("int").alias("_bq"),
                    F.explode(F.sequence(F.lit(0), F.lit(br - 1))).alias("_br"))
    rs = x.select(*[F.col(c).alias(c) for c in x.columns],
                  F.pmod(F.xxhash64("_id"), F.lit(br)).cast("int").alias("_br"),
                  F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("_bq"))
    schema = T.StructType([T.StructField("q", id_type), T.StructField("pos", T.IntegerType()),
                           T.StructField("r", id_type), T.StructField("dist", T.DoubleType()),
                           T.StructField("v", T.DoubleType())])

    def block(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({c.name: [] for c in schema.fields})
        a = left[feats].to_numpy(float)
        b = right[feats].to_numpy(float)
        pa, pb = ~np.isnan(a), ~np.isnan(b)
        # sum over commonly present features of (a-b)^2, and the common count
        m = pa.astype(float) @ pb.T.astype(float)
        s = np.zeros((a.shape[0], b.shape[0]))
        for j in range(nf):   # differences at any width: exact ties stay ties
            dj = a[:, j][:, None] - b[:, j][None, :]
            s += np.where(np.isnan(dj), 0.0, dj * dj)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.sqrt(np.clip(s, 0.0, None) * nf / m)
        d[m == 0] = np.nan
        rids = right["_id"].to_numpy()
        out = []
        for j in range(nf):
            qi = np.where(~pa[:, j])[0]
            if len(qi) == 0:
                continue
            donors = pb[:, j]
            dj = d[np.ix_(qi, np.where(donors)[0])]
            rj = rids[donors]
            vj = b[donors, j]
            if dj.shape[1] == 0:
                continue
            dr = np.round(np.where(np.isnan(dj), np.inf, dj), 9)
            order = np.lexsort((np.broadcast_to(rj, dr.shape), dr), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(qi)), order.shape[1])
            cols = order.ravel()
            ok = np.isfinite(dr[rows, cols])
            out.append(pd.DataFrame({"q": left["_id"].to_numpy()[qi][rows][ok], "pos": j,
                                     "r": rj[cols][ok], "dist": dj[rows, cols][ok],
                                     "v": vj[cols][ok]}))
        if not out:
            return pd.DataFrame({c.name: [] for c in schema.fields})
        return pd.concat(out, ignore_index=True)

    return (qs.groupBy("_bq", "_br").cogroup(rs.groupBy("_bq", "_br"))
            .applyInPandas(block, schema))
