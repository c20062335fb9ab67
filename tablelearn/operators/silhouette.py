"""Silhouette coefficients (Euclidean), exact.

The mean distance from every point to every cluster needs all pairwise
distances -- that is the definition, O(n^2) work.  The work is laid out so no
pair is ever a row: points are hashed into blocks, each pair of blocks
(a <= b) meets in one task, and the task goes through the distances a tile of
``TILE_ROWS`` x ``TILE_COLS`` at a time and keeps only the sums per (point,
cluster).  A point leaves a task once per cluster of the other block, so
blocks are as large as the sums allow: the rows shuffled are the points times
the blocks, not times the tiles.  Memory per task is a block's sums and a few
tiles; cluster skew does not matter because blocks are by id.

Several clusterings of the same points (``silhouette_analysis``) share the
distances: they are computed once, and summed by each clustering's clusters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.cells import fields, matrix
from ..functions.distance import minkowski
from ..functions.rank import maybe_broadcast
from ..session import cut_lineage, ship_package

TILE_ROWS, TILE_COLS = 64, 1024      # distances that a task holds at once
BLOCK_ROWS = 1 << 16                  # rows of a block, about, at most
BLOCK_SUMS = 1 << 22                  # sums of a block that a task holds, if that leaves ``block_rows`` rows
BLOCKS = 8                            # at least, if they have ``block_rows`` rows
FEW = 64                              # clusters that are summed by a matrix product


def _codes(c: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The clusters of all clusterings (columns of ``c``) as (clustering, cluster), and their places in that list."""
    names, place = [], np.empty(c.shape, np.int64)
    for q in range(c.shape[1]):
        found, at = np.unique(c[:, q], return_inverse=True)
        place[:, q] = at + len(names)
        names += [(q, int(v)) for v in found]
    return names, place


def _by_cluster(d: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns of ``d`` by their clusters: rows x ``n``."""
    if n <= FEW:
        member = np.zeros((len(place), n))
        member[np.arange(len(place))[:, None], place] = 1.0
        with np.errstate(invalid="ignore"):
            out = d @ member
        if np.isfinite(out).all():            # else a product would carry a NaN into other clusters
            return out
    out = np.zeros((len(d), n))
    for q in range(place.shape[1]):
        order = np.argsort(place[:, q], kind="stable")
        held, first = np.unique(place[order, q], return_index=True)
        out[:, held] = np.add.reduceat(d[:, order], first, axis=1)
    return out


def _block_sums(xa: np.ndarray, ca: np.ndarray, xb: np.ndarray, cb: np.ndarray, same: bool):
    """Sums of the distances of a block's rows to another's clusters, and (unless it is the same) the other way."""
    (names_a, at_a), (names_b, at_b) = _codes(ca), _codes(cb)
    to_b, to_a = np.zeros((len(xa), len(names_b))), np.zeros((0 if same else len(xb), len(names_a)))
    for left in range(0, len(xb), TILE_COLS):
        cols = slice(left, left + TILE_COLS)
        for top in range(0, len(xa), TILE_ROWS):
            rows = slice(top, top + TILE_ROWS)
            d = minkowski(xa[rows], xb[cols])
            if same:                          # a row's distance to itself is 0, whatever its values
                i = np.arange(max(top, left), min(top + d.shape[0], left + d.shape[1]))
                d[i - top, i - left] = 0.0
            else:
                to_a[cols] += _by_cluster(d.T, at_a[rows], len(names_a))
            to_b[rows] += _by_cluster(d, at_b[cols], len(names_b))
    return names_b, to_b, names_a, to_a


def _distance_sums(pts: DataFrame, n: int, clusters: int, block_rows: int) -> DataFrame:
    """(id, own, q, c, s): each row's distances to the clusters ``c`` of clustering ``q``, in parts to be added up."""
    ship_package(pts.sparkSession)
    most = min(BLOCK_ROWS, max(block_rows, BLOCK_SUMS // clusters))
    n_blocks = max(1, math.ceil(n / most), min(BLOCKS, math.ceil(n / block_rows)))
    blk = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    held = cut_lineage(pts.groupBy(blk.alias("b")).agg(F.collect_list(F.struct("id", "x", "c")).alias("p")))
    asking = held.select(F.col("b").alias("a"), F.col("p").alias("q"),
                         F.explode(F.sequence(F.col("b"), F.lit(n_blocks - 1))).alias("b"))
    other = held.select(F.col("b").alias("other"), F.col("p").alias("r"))
    pairs = (asking.hint("merge").join(other.hint("merge"), F.col("b") == F.col("other"))
             .select((F.col("a") == F.col("b")).alias("same"), "q", "r")
             .repartition(n_blocks * (n_blocks + 1) // 2))       # a pair is a row, and a task's work

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same, left, right = batch.column(0)[i].as_py(), *(fields(batch.column(j)[i].values) for j in (1, 2))
                own = [matrix(side["packed"].field("c")) for side in (left, right)]
                names_b, to_b, names_a, to_a = _block_sums(left["x"], own[0], right["x"], own[1], same)
                for side, c, names, sums in ((left, own[0], names_b, to_b), (right, own[1], names_a, to_a)):
                    for j, (q, name) in enumerate(names if len(sums) else ()):
                        yield pa.RecordBatch.from_arrays(
                            [side["packed"].field("id"), pa.array(c[:, q], pa.int32()),
                             pa.array(np.full(len(c), q, np.int32)), pa.array(np.full(len(c), name, np.int32)),
                             pa.array(np.ascontiguousarray(sums[:, j]))], names=["id", "own", "q", "c", "s"])

    kind = pts.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"id {kind}, own int, q int, c int, s double")


def _coefficients(df: DataFrame, features: Sequence[str], clusterings: Sequence[Column], id: str,
                  block_rows: int, least: int = 2) -> DataFrame:
    """(id, q, own, a, b, silhouette) of each clustering q that has at least two clusters.

    Fewer clusters than ``least``, or one for each row, are an error.
    """
    pts = df.select(F.col(id).alias("id"), F.array(*[as_double(c) for c in features]).alias("x"),
                    F.array(*[c.cast("int") for c in clusterings]).alias("c"))
    pts = cut_lineage(pts)
    n = pts.count()
    sizes = cut_lineage(pts.select(F.posexplode("c").alias("q", "c")).groupBy("q", "c")
                        .agg(F.count(F.lit(1)).alias("n")))
    counts = {r["q"]: r for r in sizes.groupBy("q").agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("c").isNull()).alias("bad")).collect()}
    for q in range(len(clusterings)):
        k, bad = (counts[q]["k"], counts[q]["bad"]) if q in counts else (0, 0)
        if bad:
            raise ValueError("silhouette needs a cluster for each row")
        if k < least or k > n - 1:
            raise ValueError(f"silhouette needs {least} <= clusters <= n - 1 (got {k} for n={n})")
    clusters = sum(r["k"] for r in counts.values())
    sums = _distance_sums(pts, n, clusters, block_rows)
    tot = sums.groupBy("id", "own", "q", "c").agg(F.sum("s").alias("s"))
    m = tot.join(maybe_broadcast(sizes, clusters), ["q", "c"])
    mine = F.col("c") == F.col("own")
    per = m.groupBy("id", "q", "own").agg(
        F.max(F.when(mine, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)))).alias("a"),
        F.max(F.when(mine, F.col("n"))).alias("nown"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("nown") <= 1, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    used = [q for q, r in counts.items() if r["k"] > 1]
    return per.where(F.col("q").isin(used)).select("id", "q", "own", "a", "b",
                                                   F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def silhouette_samples(df: DataFrame, features: Sequence[str], cluster: str = "cluster",
                       id: str = "id", block_rows: int = 2048) -> DataFrame:
    """(id, cluster, a, b, silhouette); a singleton cluster scores 0."""
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [id, cluster])
    s = _coefficients(df, features, [F.col(cluster)], id, block_rows)
    return s.select(F.col("id").alias(id), F.col("own").alias(cluster), "a", "b", "silhouette")


def silhouette_score(df: DataFrame, features: Sequence[str], cluster: str = "cluster",
                     id: str = "id", **kw) -> DataFrame:
    """One row: silhouette (mean over samples), n."""
    s = silhouette_samples(df, features, cluster, id, **kw)
    return s.agg(F.avg("silhouette").alias("silhouette"),
                 F.count(F.lit(1)).cast("bigint").alias("n"))


def silhouette_analysis(df: DataFrame, features: Sequence[str], id: str = "id",
                        min_clusters: int = 2, max_clusters: int = 10, seed: int = 42,
                        n_init: int = 10, block_rows: int = 2048) -> DataFrame:
    """(k, silhouette, inertia, best) for k in [min, max]; NaN counts as -1,
    the first best k wins."""
    from . import kmeans as km
    spark = df.sparkSession
    data = df.select(F.col(id), *[as_double(c).alias(c) for c in features]).persist()
    n = data.count()
    max_clusters = min(max_clusters, n - 1)
    min_clusters = max(min_clusters, 2)
    if max_clusters < min_clusters:
        raise ValueError(f"max_clusters({max_clusters}) must be >= min_clusters({min_clusters})")
    ks = range(min_clusters, max_clusters + 1)
    models = [km.kmeans(data, features, k, id, n_init=n_init, seed=seed) for k in ks]
    assigned, names = data, []
    for k, m in zip(ks, models):          # all clusterings side by side: the distances are needed once
        assigned = m.assign(assigned, id, keep=[*features, *names]).withColumnRenamed("cluster", f"_k{k}")
        names.append(f"_k{k}")
    sil = {r["q"]: r["s"] for r in _coefficients(
        assigned, features, [F.col(c) for c in names], id, block_rows, least=1)
        .groupBy("q").agg(F.avg("silhouette").alias("s")).collect()}
    rows = [(k, float(sil.get(q, float("nan"))), float(m.inertia)) for q, (k, m) in enumerate(zip(ks, models))]
    data.unpersist()
    score = [(-1.0 if math.isnan(s) else s) for _, s, _ in rows]
    best = rows[int(np.argmax(score))][0]
    out = spark.createDataFrame([(k, s, i, k == best) for k, s, i in rows],
                                "k int, silhouette double, inertia double, best boolean")
    return out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("silhouette").desc_nulls_last(), "k")))
