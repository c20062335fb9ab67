"""DBSCAN over cells; no pair of points is ever a row.

Space is cut into cubes whose diagonal is just under ``eps``, so that points
in one cube are neighbours of each other whatever their number:

1. A cube with ``min_samples`` points or more holds core points only, by
   count.  Other cubes hold fewer points than that, and these are counted
   against the boxes within ``eps`` of them (``functions.cells``).
2. The core points of a cube are one node.  Two nodes are linked if two of
   their points are within ``eps``.  First boxes decide: if two boxes of one
   node each are no further than ``eps`` from end to end, that is a link.
   Then points are compared, but only those with a box of another component
   within ``eps``; what comes out is one row for each two components that
   touch in a pair of blocks.  So a cube with half of all rows costs about as
   much as the same rows spread out.
3. Clusters are the components of nodes (``functions.components``), numbered
   by their smallest core id (the reference expands clusters from core points
   in row order); a border point takes the lowest cluster number among its
   core neighbours; the rest is noise (-1).

``eps`` is inclusive, and a point counts itself.  Missing features are an
error; ids must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions import cells
from ..functions.components import connected_components
from ..functions.rank import global_rank
from ..session import cut_lineage, ship_package

NARROW = 1 - 1e-12       # of a cube's side, against rounding


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        total += gap * gap
    return total <= eps * eps


class _Space:
    """Points in cells, and their comparison within ``eps``."""

    def __init__(self, points: DataFrame, n: int, width: int, eps: float):
        self.width, self.eps = width, eps
        self.splits = cells.learn_splits(points, n, width)
        self.points = cut_lineage(cells.with_cell(points, self.splits, n))

    def boxes(self, points: DataFrame, extra: Sequence[str] = ()) -> cells.Boxes:
        return cells.boxes(points, 1 << self.splits.depth, self.width, extra)

    def compare(self, asking: DataFrame, held: DataFrame, fn, schema: list[tuple[str, str]],
                box: cells.Boxes | None = None, wanted=None) -> DataFrame:
        """``fn`` of each block of ``asking`` with the blocks of ``held`` in its cell and within eps."""
        ours, theirs = cut_lineage(cells.pack(asking)), cut_lineage(cells.pack(held))
        out = cells.compare(ours, theirs, fn, schema)
        if self.splits.depth:
            far = self.eps * (1 + 1e-9)
            needs = cells.reach(ours, box or self.boxes(held), 2.0, lambda q, own: np.full(len(q["x"]), far), wanted)
            out = out.union(cells.compare(needs, theirs, fn, schema))
        return out


def _core_points(space: _Space, kind: str, min_samples: int) -> DataFrame:
    """(id, x, cell, block, core, node): whether each point is core; node is its cube's smallest core id."""
    eps = space.eps
    cubes = space.points.groupBy("cube").agg(F.count(F.lit(1)).alias("n"))
    placed = space.points.join(cubes.withColumnRenamed("cube", "c"), F.col("cube") == F.col("c")).drop("c")
    few = placed.where(F.col("n") < min_samples).select("id", "x", "cell", "block")
    counted = space.compare(
        few, space.points.select("id", "x", "cell", "block"),
        lambda q, r: [q["packed"].field("id"), _within(q["x"], r["x"], eps).sum(axis=1)],
        [("i", kind), ("near", "bigint")])
    enough = counted.groupBy("i").agg(F.sum("near").alias("near")).where(F.col("near") >= min_samples).select("i")
    flagged = cut_lineage(placed.join(enough, F.col("id") == F.col("i"), "left").select(
        "id", "x", "cell", "block", "cube", ((F.col("n") >= min_samples) | F.col("i").isNotNull()).alias("core")))
    nodes = flagged.where("core").groupBy("cube").agg(F.min("id").alias("node")).withColumnRenamed("cube", "c")
    return cut_lineage(flagged.join(nodes, F.col("cube") == F.col("c"), "left").select(
        "id", "x", "cell", "block", "core", F.when(F.col("core"), F.col("node")).alias("node")))


def _box_links(core: DataFrame, box: cells.Boxes, eps: float, kind: str) -> DataFrame:
    """(a, b) of nodes that fill a box each, no further than eps from end to end."""
    one = np.array([n > 0 and a == b for n, a, b in zip(box.count, box.least["comp"], box.most["comp"])])
    told = core.sparkSession.sparkContext.broadcast((box, np.flatnonzero(one)))
    turns = core.sparkSession.range(0, max(1, len(np.flatnonzero(one))), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, one = told.value
        for b in batches:
            for i in b.column(0).to_pylist():
                if i < len(one):
                    k = one[i:i + 1]
                    near = one[box.span(box.lo[k], box.hi[k], 2.0, one)[0] <= eps * NARROW]
                    names = sorted({box.least["comp"][j] for j in near} - {box.least["comp"][k[0]]})
                    if names:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([box.least["comp"][k[0]]] * len(names)), pa.array(names)], names=["a", "b"])

    return cut_lineage(turns.mapInArrow(run, f"a {kind}, b {kind}"))


def _touching(q: dict, r: dict, eps: float) -> list:
    """(a, b): components of two blocks with a pair of points within eps."""
    mine, a = np.unique(q["comp"], return_inverse=True)
    theirs, b = np.unique(r["comp"], return_inverse=True)
    if len(mine) == len(theirs) == 1 and mine[0] == theirs[0]:
        return [mine[:0], mine[:0]]
    i, j = np.nonzero(_within(q["x"], r["x"], eps))
    pairs = np.unique(a[i] * len(theirs) + b[j])
    x, y = mine[pairs // len(theirs)], theirs[pairs % len(theirs)]
    apart = x != y
    return [x[apart], y[apart]]


def _clusters(space: _Space, core: DataFrame, kind: str) -> DataFrame:
    """(node, component) of nodes that are linked to others."""
    links = None
    core = core.withColumn("comp", F.col("node"))
    if space.splits.depth:
        links = _box_links(core, space.boxes(core, ["comp"]), space.eps, kind)
        joined = connected_components(links)
        core = cut_lineage(core.join(joined.withColumnRenamed("node", "m"), F.col("comp") == F.col("m"), "left")
                           .withColumn("comp", F.coalesce("component", "comp")).drop("m", "component"))
    box, eps = space.boxes(core, ["comp"]), space.eps
    least, most = box.least["comp"], box.most["comp"]
    other = lambda q, c: (least[c] != most[c])[None, :] | (least[c][None, :] != q["comp"][:, None])
    points = core.select("id", "x", "comp", "cell", "block")
    found = space.compare(points, points, lambda q, r: _touching(q, r, eps), [("a", kind), ("b", kind)], box, other)
    # a comp is the smallest node of those that boxes linked
    return connected_components(found.union(links) if links is not None else found)


def dbscan(df: DataFrame, features: Sequence[str], eps: float = 0.5, min_samples: int = 5,
           id: str = "id") -> DataFrame:
    """(id, cluster, is_core); noise = -1."""
    features, eps = list(features), float(eps)
    check_numeric(df, features)
    check_columns(df, [id])
    if not eps > 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    ship_package(df.sparkSession)
    x = F.array(*[as_double(c) + F.lit(0.0) for c in features])
    side = eps / math.sqrt(len(features)) * NARROW
    points = df.select(F.col(id).alias("id"), x.alias("x"))
    n, bad = points.agg(F.count(F.lit(1)), F.count(F.when(F.exists("x", lambda v: v.isNull()), 1))).first()
    if bad:
        raise ValueError(f"{bad} rows have a missing feature")
    kind = points.schema["id"].dataType.simpleString()
    points = points.withColumn("cube", F.transform("x", lambda v: F.floor(v / F.lit(side))))
    space = _Space(points, n, len(features), eps)
    flagged = _core_points(space, kind, min_samples)
    core = flagged.where("core").drop("core")
    joined = _clusters(space, core, kind)
    named = cut_lineage(core.join(joined.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
                        .withColumn("root", F.coalesce("component", "node")).drop("m", "component", "node"))
    number = global_rank(named.select(F.col("root").alias("m")).distinct(), [F.col("m")], "cluster")
    named = cut_lineage(named.join(number.withColumn("cluster", F.col("cluster").cast("int")),
                                   F.col("root") == F.col("m")).select("id", "x", "cell", "block", "cluster"))

    def lowest(q: dict, r: dict) -> list:
        near = _within(q["x"], r["x"], eps)
        best = np.where(near, r["cluster"][None, :], np.iinfo(np.int32).max).min(axis=1)
        some = near.any(axis=1)
        return [q["packed"].field("id").filter(pa.array(some)), pa.array(best[some], pa.int32())]

    border = space.compare(flagged.where("not core").select("id", "x", "cell", "block"), named, lowest,
                           [("id", kind), ("cluster", "int")]).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = named.select("id", "cluster", F.lit(True).alias("is_core")).union(
        border.withColumn("is_core", F.lit(False)))
    out = df.select(F.col(id).alias("_id")).join(found, F.col("_id") == F.col("id"), "left")
    return out.select(F.col("_id").alias(id), F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                      F.coalesce("is_core", F.lit(False)).alias("is_core"))


def summary(labels: DataFrame) -> DataFrame:
    """One row: n_clusters, n_noise, noise_share, n_core, n."""
    return labels.agg(
        F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).cast("bigint")
        .alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).cast("bigint").alias("n_noise"),
        (F.count_if(F.col("cluster") == -1) / F.count(F.lit(1))).alias("noise_share"),
        F.count_if("is_core").cast("bigint").alias("n_core"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def silhouette(df: DataFrame, labels: DataFrame, features: Sequence[str], id: str = "id") -> DataFrame:
    """(silhouette, n) over the points of clusters, noise left out."""
    from .silhouette import silhouette_score
    inside = labels.where("cluster >= 0").select(F.col(id).alias("_l"), "cluster")
    return silhouette_score(df.select(id, *features).join(inside, F.col(id) == F.col("_l")).drop("_l"),
                            list(features), "cluster", id)
