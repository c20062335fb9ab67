"""K-means clustering.

Two engines:

* ``init_centers`` given -> Lloyd iterations written as DataFrame ops: each
  step is one narrow assignment projection (argmin over k literal centres,
  ties -> lowest index) plus one ``groupBy(cluster).avg`` (partial
  aggregation, k rows out).  Deterministic; checked against SQL.
* otherwise MLlib ``KMeans`` (k-means|| or random init) run ``n_init`` times
  with seeds ``seed .. seed + n_init - 1``; the lowest inertia wins.  Labels
  are renumbered by the smallest member id so they do not depend on init.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.exprs import num, sql_sum


@dataclass
class KMeansModel:
    features: list[str]
    centers: np.ndarray      # (k, p)
    inertia: float
    n_iter: int

    @property
    def k(self):
        return len(self.centers)

    def _dist_sql(self, ci: int) -> str:
        return sql_sum([f"((_x{j} - {num(m)}) * (_x{j} - {num(m)}))"
                        for j, m in enumerate(self.centers[ci])])

    def assign(self, df: DataFrame, id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
        """(id, keep..., cluster, d2): nearest centre, ties -> lowest index."""
        ids = [F.col(id), *[F.col(c) for c in keep]]
        xs = df.select(*ids, *[as_double(c).alias(f"_x{j}") for j, c in enumerate(self.features)])
        ds = xs.select(*ids, *[F.expr(self._dist_sql(i)).alias(f"_d{i}") for i in range(self.k)])
        d = [f"_d{i}" for i in range(self.k)]
        mn = f"least({', '.join(d)})" if self.k > 1 else d[0]
        t = ds.select(*ids, *[F.col(c) for c in d], F.expr(mn).alias("d2"))
        pick = "CASE " + " ".join(f"WHEN {d[i]} = d2 THEN {i}" for i in range(self.k)) + " END"
        return t.select(*ids, F.expr(pick).cast("int").alias("cluster"), "d2")

    def centers_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, j, f, float(self.centers[i, j]))
                for i in range(self.k) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "cluster int, pos int, feature string, center double")


def _update(model: KMeansModel, data: DataFrame, id: str):
    a = model.assign(data, id, keep=model.features)   # the features come along: no join
    g = a.groupBy("cluster").agg(
        F.sum("d2").alias("_sse"), *[F.avg(as_double(c)).alias(f"_m{j}")
                                     for j, c in enumerate(model.features)]).collect()
    return g


def lloyd(df: DataFrame, features: Sequence[str], init_centers, id: str = "id",
          max_iter: int = 300) -> KMeansModel:
    """Lloyd iterations from given centres; an empty cluster keeps its centre."""
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [id])
    data = df.select(F.col(id), *[as_double(c).alias(c) for c in features]).persist()
    centers = np.array(init_centers, dtype=float)
    model = KMeansModel(features, centers, float("nan"), 0)
    it = 0
    for it in range(1, max_iter + 1):
        g = _update(model, data, id)
        new = model.centers.copy()
        for r in g:
            new[r["cluster"]] = [r[f"_m{j}"] for j in range(len(features))]
        changed = not np.array_equal(new, model.centers)
        model = KMeansModel(features, new, float("nan"), it)
        if not changed:
            break
    sse = model.assign(data, id).agg(F.sum("d2")).first()[0]
    data.unpersist()
    return KMeansModel(features, model.centers, float(sse), it)


def first_rows_centers(df: DataFrame, features: Sequence[str], k: int, id: str = "id"):
    """The first k rows by id as initial centres (deterministic init)."""
    rows = df.select(id, *features).orderBy(id).limit(k).collect()
    return [[float(r[c]) for c in features] for r in rows]


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, id: str = "id",
           init: str = "k-means++", n_init: int = 10, max_iter: int = 300, seed: int = 0,
           tol: float = 1e-4, init_centers=None) -> KMeansModel:
    features = list(features)
    if init_centers is not None:
        return lloyd(df, features, init_centers, id, max_iter)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    check_numeric(df, features)
    init = init.strip().lower()
    if init not in ("k-means++", "random"):
        raise ValueError("init must be 'k-means++' or 'random'")
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(
        df.select(F.col(id), *[as_double(c).alias(c) for c in features])).persist()
    def run(r):
        est = KMeans(k=int(k), featuresCol="_features", maxIter=int(max_iter), tol=tol,
                     seed=int(seed) + r,
                     initMode="k-means||" if init == "k-means++" else "random")
        m = est.fit(data)
        return (m.summary.trainingCost, r, m)
    # restarts are independent jobs: submit them concurrently
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(4, max(1, int(n_init)))) as ex:
        fits = list(ex.map(run, range(max(1, int(n_init)))))
    cost, _, m = min(fits, key=lambda t: (t[0], t[1]))
    centers = np.array([c for c in m.clusterCenters()], dtype=float)
    model = KMeansModel(features, centers, float(cost), m.summary.numIter)
    data.unpersist()
    return renumber(model, df, id)


def renumber(model: KMeansModel, df: DataFrame, id: str) -> KMeansModel:
    """Order centres by the smallest member id (empty clusters last)."""
    a = model.assign(df, id)
    first = {r["cluster"]: r["m"] for r in
             a.groupBy("cluster").agg(F.min(id).alias("m")).collect()}   # k rows
    order = sorted(range(model.k), key=lambda c: (c not in first, first.get(c, 0), c))
    return KMeansModel(model.features, model.centers[order], model.inertia, model.n_iter)


def cluster_sizes(assign: DataFrame, k: int | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, share); with ``k`` every cluster 0..k-1 is listed (empty = 0)."""
    spark = assign.sparkSession
    g = assign.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).cast("bigint").alias("size"))
    if k is not None:
        allc = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
        g = allc.join(g, "cluster", "left").select(
            "cluster", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    tot = assign.count()
    return g.select("cluster", "size", (F.col("size") / F.lit(float(tot))).alias("share"))
