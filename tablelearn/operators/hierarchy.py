"""Agglomerative (hierarchical) clustering: ward, complete, average, single.

Single linkage and ward are distributed; no row comes to the driver.

* **Single** linkage is the minimum spanning tree of the points, by Boruvka
  rounds.  In a round every component finds its shortest edge to another one:
  the points of a cell (``functions.cells``) are compared first, which bounds
  the component's edge, and then only the points with a foreign box inside
  that bound meet that box's points.  A component that fills all its cells is
  bounded by the distance over which a foreign cell is sure to be reached.
  Components at least halve in number each round; which of them join is
  found by ``functions.components``, or on the driver once a round's edges are
  at most ``CONTRACT`` rows.
* **Ward** merges reciprocal nearest neighbours, round by round: every cluster
  (size, centroid) finds its nearest one under the ward distance, and pairs
  that chose each other become one.  As merging never brings a cluster nearer
  to a third one, these are merges of the sequential algorithm.  Boxes hold
  centroids, and the least size in a box bounds its distance.  The last
  ``FINISH`` clusters, whatever the table's size, are merged by the
  nearest-neighbour chain on the driver.
* **Complete** and **average** linkage merge reciprocal nearest neighbours too.
  A cluster carries its points; no linkage is less than the distance of the
  centroids, so boxes of centroids say which clusters must be compared point
  by point.  Of the last ``FEW`` clusters, blocks of points meet in tasks that
  add up the clusters' linkages, and the chain merges that table, whatever the
  number of rows.  This last step compares all rows, ``n * n / 2`` distances.
  ``max_points`` and ``approximate`` ask for k-means micro-clusters instead.

Rows with equal coordinates are one weighted point, merged at height 0.  The
merges that stay below the cut are edges between the clusters' smallest
members, and their components are the labels, numbered by smallest member.
Ties: edges are compared by (height, smaller id, larger id), so results repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions import cells
from ..functions.components import connected_components
from ..functions.distance import minkowski
from ..functions.rank import global_rank, maybe_broadcast
from ..session import cut_lineage, ship_package

LINKAGES = ("ward", "complete", "average", "single")
METRICS = {"euclidean": 2.0, "l2": 2.0, "manhattan": 1.0, "l1": 1.0, "cityblock": 1.0, "chebyshev": math.inf,
           "cosine": 2.0}
FINISH = 128              # clusters that ward leaves to the chain
FEW = 1024                # clusters that complete and average linkage leave to it
BLOCKS = 48               # of points, at most, that meet for the linkages of these
BLOCK_ROWS = 4096         # points of such a block, at least
CHUNK = 1 << 20           # distances that are held at once
CONTRACT = 1 << 16        # components whose edges are joined on the driver; beyond that by rounds of joins


def nn_chain(X: np.ndarray, w: np.ndarray, linkage: str, p: float = 2.0, squared: bool = False) -> np.ndarray:
    """Merges (a, b, height, size) in the order found; a, b are cluster ids
    (0..m-1 points, m.. merged clusters, scipy convention)."""
    D = minkowski(X, X, p)
    if squared:
        D = D * D / 2
    if linkage == "ward":
        ww = w[:, None] * w[None, :]
        D = np.sqrt(2.0 * ww / (w[:, None] + w[None, :])) * D
    return _chain(D, w, linkage)


def _chain(D: np.ndarray, w: np.ndarray, linkage: str) -> np.ndarray:
    """``nn_chain`` of clusters with these linkages, which are overwritten, and weights."""
    m = len(D)
    np.fill_diagonal(D, np.inf)
    size = w.astype(float).copy()
    active = np.ones(m, dtype=bool)
    cid = np.arange(m)                      # current cluster id stored at slot
    merges = []
    chain: list[int] = []
    next_id = m
    remaining = m
    while remaining > 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        a = chain[-1]
        row = np.where(active, D[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))             # smallest index among ties
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]                   # prefer the previous element on ties
        if len(chain) > 1 and b == chain[-2]:
            chain.pop(); chain.pop()
            h = D[a, b]
            na, nb = size[a], size[b]
            lo, hi = min(a, b), max(a, b)
            merges.append((cid[a], cid[b], h, na + nb))
            # Lance-Williams update into slot lo
            dk_a, dk_b = D[a].copy(), D[b].copy()
            if linkage == "single":
                new = np.minimum(dk_a, dk_b)
            elif linkage == "complete":
                new = np.maximum(dk_a, dk_b)
            elif linkage == "average":
                new = (na * dk_a + nb * dk_b) / (na + nb)
            else:
                nk = size
                t = na + nb + nk
                new = np.sqrt(np.clip(((na + nk) * dk_a ** 2 + (nb + nk) * dk_b ** 2
                                       - nk * h ** 2) / t, 0.0, None))
            D[lo, :] = new
            D[:, lo] = new
            D[lo, lo] = np.inf
            active[hi] = False
            D[hi, :] = np.inf
            D[:, hi] = np.inf
            size[lo] = na + nb
            cid[lo] = next_id
            next_id += 1
            remaining -= 1
        else:
            chain.append(b)
    return np.array(merges, dtype=float).reshape(-1, 4)


def cut(merges: np.ndarray, m: int, n_clusters: int) -> np.ndarray:
    """Flat labels (by union-find) after the m - n_clusters lowest merges."""
    order = np.argsort(merges[:, 2], kind="stable")
    parent = list(range(2 * m))
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    # replay merges in height order, mapping merged ids to representatives
    srt = merges[order]
    # ids in ``merges`` refer to creation order; rebuild the creation mapping
    created = {}
    for i, (a, b, _, _) in enumerate(merges):
        created[m + i] = (int(a), int(b))
    def leaf_of(c):
        while c >= m:
            c = created[c][0]
        return c
    for a, b, _, _ in srt[: max(0, m - n_clusters)]:
        ra, rb = find(leaf_of(int(a))), find(leaf_of(int(b)))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return np.array([find(i) for i in range(m)])


# -- points and edges -------------------------------------------------------

def _edge(height: str = "d", a: str = "a", b: str = "b") -> Column:
    """An edge as a struct that compares by height, smaller and larger end."""
    return F.struct(F.col(height).alias("d"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct points (id, x, w) under their smallest id, and the edges (a, b, d) of their other rows."""
    points = cut_lineage(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))
                         .select("id", "x", "w"))
    many = points.where("w > 1").select(F.col("id").alias("a"), F.col("x").alias("y"))
    zero = rows.join(many, F.col("x") == F.col("y")).where("id <> a").select(
        "a", F.col("id").alias("b"), F.lit(0.0).alias("d"))
    return points, zero


# -- single linkage: Boruvka rounds -----------------------------------------

def _least_edges(own: np.ndarray, other: np.ndarray, ids: np.ndarray, others: np.ndarray,
                 d: np.ndarray) -> list:
    """(comp, d, lo, hi, foreign comp): the least edge of each component in ``own`` by (d, lo, hi)."""
    names, code = np.unique(own, return_inverse=True)
    least = np.full(len(names), np.inf)
    np.minimum.at(least, code, d.min(axis=1))
    i, j = np.nonzero((d == least[code][:, None]) & np.isfinite(d))
    a, b = ids[i], others[j]
    lo, hi = np.where(a < b, a, b), np.where(a < b, b, a)
    by = np.lexsort([hi, lo, code[i]])
    by = by[np.diff(code[i][by], prepend=-1) != 0]
    return [own[i][by], d[i, j][by], lo[by], hi[by], other[j][by]]


def _foreign(q: dict, r: dict, p: float) -> list:
    d = minkowski(q["x"], r["x"], p)
    d[q["comp"][:, None] == r["comp"][None, :]] = np.inf
    if "radius" in q:
        d[d > q["radius"][:, None]] = np.inf
    return _least_edges(q["comp"], r["comp"], q["id"], r["id"], d)


def _pure_radius(box: cells.Boxes, comps: list, p: float) -> dict:
    """For components that fill their cells: a distance within which there is a point of another one."""
    pure = np.array([n > 0 and a == b for n, a, b in zip(box.count, box.least["comp"], box.most["comp"])])
    out = {}
    for comp in comps:
        mine = np.flatnonzero(pure & (box.least["comp"] == comp))
        rest = np.flatnonzero((box.count > 0) & ~(pure & (box.least["comp"] == comp)))
        if len(mine) and len(rest):
            out[comp] = min(float(box.span(box.lo[part], box.hi[part], p, rest).min())
                            for part in np.array_split(mine, max(1, len(mine) * len(rest) >> 22)))
    return out


def minimum_spanning_tree(rows: DataFrame, width: int, p: float = 2.0) -> DataFrame:
    """(a, b, d): the edges of a minimum spanning tree of rows (id, x), rows of equal place joined at 0."""
    points, zero = _distinct(rows)
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    schema = [("comp", kind), ("d", "double"), ("lo", kind), ("hi", kind), ("other", kind)]
    found, left = cut_lineage(zero), points.count()
    splits = cells.learn_splits(points, left, width)
    points = cells.with_cell(points.select("id", "x", F.col("id").alias("comp")), splits, left)
    while left > 1:
        held = cut_lineage(cells.pack(points))
        best = cells.compare(held, held, lambda q, r: _foreign(q, r, p), schema)
        if splits.depth:
            box = cells.boxes(points, 1 << splits.depth, width, ["comp"])
            bound = cut_lineage(best.groupBy("comp").agg(F.min("d").alias("radius")))
            full = sorted({a for n, a, b in zip(box.count, box.least["comp"], box.most["comp"]) if n and a == b})
            filled = spark.createDataFrame([(c,) for c in full], f"comp {kind}")          # a row per cell at most
            loose = _pure_radius(box, [r["comp"] for r in filled.join(bound, "comp", "left_anti").collect()], p)
            bound = bound.union(spark.createDataFrame(list(loose.items()), f"comp {kind}, radius double"))
            asking = cells.pack(points.join(bound, "comp").select("cell", "block", "id", "x", "comp", "radius"))
            least, most = box.least["comp"], box.most["comp"]
            foreign = lambda q, c: (least[c] != most[c])[None, :] | (least[c][None, :] != q["comp"][:, None])
            needs = cells.reach(asking, box, p, lambda q, own: q["radius"], foreign)
            best = best.union(cells.compare(needs, held, lambda q, r: _foreign(q, r, p), schema))
        chosen = best.groupBy("comp").agg(F.min(F.struct("d", "lo", "hi", "other")).alias("e")).select("comp", "e.*")
        if left > CONTRACT:
            chosen = cut_lineage(chosen)
            joined = connected_components(chosen.select("comp", "other"))
            left = joined.select("component").distinct().count()
        else:                                     # a row for each of at most CONTRACT components
            rows = chosen.collect()
            roots = _roots([(r["comp"], r["other"]) for r in rows])
            chosen = spark.createDataFrame(rows, chosen.schema)
            joined = F.broadcast(spark.createDataFrame(list(roots.items()), f"node {kind}, component {kind}"))
            left = len(set(roots.values()))
        found = found.union(chosen.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d").distinct())
        points = points.join(joined, F.col("comp") == F.col("node")).select(
            "id", "x", F.col("component").alias("comp"), "cell", "block")
        points = cut_lineage(points) if left > 1 else points
    return found


def _roots(edges: list[tuple]) -> dict:
    """The smallest node of each node's component."""
    root = {a: a for e in edges for a in e}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {a: find(a) for a in root}


# -- ward: reciprocal nearest neighbours ------------------------------------

def _factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the centroids' distance is multiplied by between clusters of sizes a and b."""
    return np.sqrt(2.0 * a * b / (a + b))


def _nearest(q: dict, r: dict) -> list:
    """(id, d, lo, hi): each cluster's nearest in another block by (d, lo, hi)."""
    d = minkowski(q["x"], r["x"]) * _factor(q["w"][:, None], r["w"][None, :])
    d[q["id"][:, None] == r["id"][None, :]] = np.inf
    return _least_edges(q["id"], r["id"], q["id"], r["id"], d)[:4]


def ward_merges(rows: DataFrame, width: int) -> DataFrame:
    """(a, b, d, round): merges of the ward tree over rows (id, x), named by the smallest member of each side."""
    spark = rows.sparkSession
    now, zero = _distinct(rows)
    kind = rows.schema["id"].dataType.simpleString()
    found, turn, n = cut_lineage(zero.withColumn("round", F.lit(0))), 0, now.count()
    schema = [("id", kind), ("d", "double"), ("lo", kind), ("hi", kind)]
    while n > FINISH:
        turn += 1
        splits = cells.learn_splits(now, n, width)
        placed = cells.with_cell(now, splits, n)
        held = cut_lineage(cells.pack(placed))
        best = cells.compare(held, held, _nearest, schema)
        if splits.depth:
            box = cells.boxes(placed, 1 << splits.depth, width, ["w"])
            bound = best.groupBy("id").agg(F.min("d").alias("radius")).withColumnRenamed("id", "i")
            asking = cells.pack(placed.join(bound, F.col("id") == F.col("i"), "left").drop("i"))
            least = np.array([1.0 if v is None else v for v in box.least["w"]])
            most = np.array([1.0 if v is None else v for v in box.most["w"]])

            def radius(q: dict, own: int) -> np.ndarray:
                """Centroid distance within which a nearer cluster can be: sizes are 1 at least."""
                known = q["radius"].astype(float)
                for i in np.flatnonzero(np.isnan(known)):             # alone in its cell
                    x = q["x"][i:i + 1]
                    reach = box.span(x, x, 2.0)[0] * _factor(q["w"][i], most)
                    reach[own] = np.inf
                    known[i] = reach.min()
                q["bound"] = known
                return known / _factor(q["w"], 1.0)

            def wanted(q: dict, c: np.ndarray) -> np.ndarray:
                return box.gap(q["x"], q["x"], 2.0, c) * _factor(q["w"][:, None], least[c][None, :]) <= (
                    q["bound"][:, None] * (1 + 1e-12))

            needs = cells.reach(asking, box, 2.0, lambda q, own: radius(q, own) * (1 + 1e-12), wanted)
            best = best.union(cells.compare(needs, held, _nearest, schema))
        nearest = best.groupBy("id").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("e.*")
        pairs = cut_lineage(nearest.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
                            .where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d"))
        side = lambda s: now.select(F.col("id").alias(s), F.col("x").alias(f"x_{s}"), F.col("w").alias(f"w_{s}"))
        merged = pairs.join(side("a"), "a").join(side("b"), "b").select(
            F.col("a").alias("id"),
            F.zip_with("x_a", "x_b", lambda x, y: (x * F.col("w_a") + y * F.col("w_b")) / (F.col("w_a") + F.col("w_b")))
            .alias("x"), (F.col("w_a") + F.col("w_b")).alias("w"))
        gone = pairs.select(F.col("a").alias("i")).union(pairs.select("b"))
        now = cut_lineage(now.join(gone, F.col("id") == F.col("i"), "left_anti").union(merged))
        found = found.union(pairs.withColumn("round", F.lit(turn)))
        n = now.count()
    rest = now.orderBy("id").collect()                                # FINISH rows at most
    names = [r["id"] for r in rest]
    tree = nn_chain(np.array([r["x"] for r in rest], float).reshape(len(rest), -1),
                    np.array([r["w"] for r in rest], float), "ward")
    last = []
    for k, (a, b, d, _) in enumerate(tree):
        lo, hi = sorted((names[int(a)], names[int(b)]))
        names.append(lo)
        last.append((lo, hi, float(d), turn + 1 + k))
    return found.union(spark.createDataFrame(last, f"a {kind}, b {kind}, d double, round int"))


# -- complete and average linkage: reciprocal nearest neighbours -------------

@dataclass(frozen=True)
class _Linkage:
    """How far apart two clusters are; goes to the tasks."""
    name: str                  # complete or average
    p: float
    squared: bool              # half the square of the distance, for cosine

    def of(self, d: np.ndarray) -> np.ndarray:
        return d * d / 2 if self.squared else d

    def radius(self, d: np.ndarray) -> np.ndarray:
        """The distance of points that are linked at ``d``."""
        return np.sqrt(2 * d) if self.squared else d

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each row of ``a`` to the same row of ``b``."""
        diff = np.abs(a - b)
        if math.isinf(self.p):
            return self.of(diff.max(axis=1))
        return self.of(diff.sum(axis=1) if self.p == 1.0 else np.sqrt((diff * diff).sum(axis=1)))

    def large(self, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
        """Of two clusters, from their points and weights."""
        total = 0.0
        for i in range(0, len(a), step := max(1, CHUNK // len(b))):
            d = self.of(minkowski(a[i:i + step], b, self.p))
            total = max(total, d.max()) if self.name == "complete" else total + float(wa[i:i + step] @ d @ wb)
        return total if self.name == "complete" else total / (wa.sum() * wb.sum())

    def between(self, q: dict, r: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the clusters i of block ``q`` and j of block ``r``; the same whichever side they are on."""
        width = q["x"].shape[1]
        pts, wts, start, size = [], [], [], []
        for block, far in ((q, 0), (r, len(q["packed"].field("v").flatten()))):
            m, v = block["packed"].field("m"), block["packed"].field("v")
            pts.append(m.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            wts.append(v.flatten().to_numpy(zero_copy_only=False))
            n = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            size.append(n)
            start.append(far + np.cumsum(n) - n)
        pts, wts = np.concatenate(pts), np.concatenate(wts)
        turned = q["id"][i] > r["id"][j]
        one, other = np.where(turned, start[1][j], start[0][i]), np.where(turned, start[0][i], start[1][j])
        n, m = np.where(turned, size[1][j], size[0][i]), np.where(turned, size[0][i], size[1][j])
        out = np.empty(len(i))
        small = np.flatnonzero(n * m <= CHUNK >> 8)
        for k in np.flatnonzero(n * m > CHUNK >> 8):
            a, b = slice(one[k], one[k] + n[k]), slice(other[k], other[k] + m[k])
            out[k] = self.large(pts[a], wts[a], pts[b], wts[b])
        ends = np.cumsum((n * m)[small])
        for part in np.split(small, np.searchsorted(ends, np.arange(CHUNK, ends[-1] if len(ends) else 0, CHUNK))):
            if not len(part):
                continue
            count = (n * m)[part]
            first = np.cumsum(count) - count
            at = np.arange(count.sum()) - np.repeat(first, count)
            a = np.repeat(one[part], count) + at // np.repeat(m[part], count)
            b = np.repeat(other[part], count) + at % np.repeat(m[part], count)
            d = self.rows(pts[a], pts[b])
            if self.name == "complete":
                out[part] = np.maximum.reduceat(d, first)
            else:
                weight = wts[a] * wts[b]
                out[part] = np.add.reduceat(d * weight, first) / np.add.reduceat(weight, first)
        return out

    def nearest(self, q: dict, r: dict) -> list:
        """(id, d, lo, hi): each cluster's nearest in another block by (d, lo, hi)."""
        low = minkowski(q["x"], r["x"], self.p)
        slack = 1e-12 * max(np.abs(q["x"]).max(), np.abs(r["x"]).max())        # centroids are rounded
        low = self.of(np.maximum(0.0, low * (1 - 1e-9) - slack))
        same = q["id"][:, None] == r["id"][None, :]
        low[same] = np.inf
        d, some = np.full(low.shape, np.inf), min(4, low.shape[1])
        first = np.argpartition(low, some - 1, axis=1)[:, :some]
        i, j = np.repeat(np.arange(len(low)), some), first.ravel()
        keep = np.isfinite(low[i, j])
        i, j = i[keep], j[keep]
        d[i, j] = self.between(q, r, i, j)
        i, j = np.nonzero((low <= d.min(axis=1)[:, None]) & np.isinf(d) & ~same)
        d[i, j] = self.between(q, r, i, j)
        return _least_edges(q["id"], r["id"], q["id"], r["id"], d)[:4]


def _linkages(points: DataFrame, n: int, m: int, link: _Linkage) -> np.ndarray:
    """The linkages of ``m`` clusters, from their ``n`` points (id, at, x, w), ``at`` the cluster's number.

    Blocks of points meet in pairs; a task adds up its pairs' share of the
    table, and the shares are added row by row.  A row per cluster comes back.
    """
    spark = points.sparkSession
    count = max(1, min(BLOCKS, math.ceil(n / BLOCK_ROWS)))
    blocks = cut_lineage(points.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")).agg(
        F.collect_list(F.struct("at", "x", "w")).alias("p")))
    left = blocks.select(F.col("block").alias("i"), F.col("p").alias("q"), F.explode(
        F.sequence("block", F.lit(count - 1).cast("bigint"))).alias("j"))
    pairs = left.hint("merge").join(blocks.hint("merge"), F.col("j") == F.col("block")).select("i", "j", "q", "p")
    add = np.maximum if link.name == "complete" else np.add

    def block_of(p: pa.StructArray) -> tuple:
        b = cells.fields(p)
        by = np.argsort(b["at"], kind="stable")
        at = b["at"][by]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return b["x"][by], b["w"][by], at, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                total = np.zeros((m, m)) if total is None else total
                (x, w, at, _), (y, v, to, first) = (block_of(batch.column(c)[k].values) for c in (2, 3))
                part = np.zeros((m, m))
                for lo in range(0, len(x), step := max(1, CHUNK // len(y))):
                    d = link.of(minkowski(x[lo:lo + step], y, link.p))
                    if link.name == "average":
                        d *= w[lo:lo + step, None] * v[None, :]
                    mine = at[lo:lo + step]
                    begin = np.flatnonzero(np.diff(mine, prepend=-1))
                    d = add.reduceat(add.reduceat(d, first, axis=1), begin, axis=0)
                    where = np.ix_(mine[begin], to[first])
                    part[where] = add(part[where], d)
                total = add(total, part)
                if batch.column(0)[k].as_py() != batch.column(1)[k].as_py():
                    total = add(total, part.T)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array([r.tobytes() for r in total],
                                                                               pa.binary())], names=["at", "s"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        s = add.reduce([np.frombuffer(r) for r in pdf["s"]])
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "s": [s.tobytes()]})

    ship_package(spark)
    rows = pairs.mapInArrow(run, "at bigint, s binary").groupBy("at").applyInPandas(
        together, "at bigint, s binary").orderBy("at").collect()                 # m rows of m numbers
    return np.stack([np.frombuffer(r["s"]) for r in rows])


def linked_merges(rows: DataFrame, width: int, link: _Linkage) -> DataFrame:
    """(a, b, d, round): merges of the tree over rows (id, x), named by the smallest member of each side."""
    spark = rows.sparkSession
    now, zero = _distinct(rows)
    kind = rows.schema["id"].dataType.simpleString()
    found, turn, n = cut_lineage(zero.withColumn("round", F.lit(0))), 0, now.count()
    now, points = now.select("*", F.col("x").alias("m"), F.array("w").alias("v")), n
    schema = [("id", kind), ("d", "double"), ("lo", kind), ("hi", kind)]
    while n > FEW:
        turn += 1
        share = max(16, min(cells.CELL_ROWS, n // 64))                # small enough for many tasks
        splits = cells.learn_splits(now.select("id", "x"), n, width, share)
        placed = cells.with_cell(now, splits, n, share)
        held = cut_lineage(cells.pack(placed))
        best = cells.compare(held, held, link.nearest, schema)
        if splits.depth:
            box = cells.boxes(placed, 1 << splits.depth, width)
            bound = best.groupBy("id").agg(F.min("d").alias("radius")).withColumnRenamed("id", "i")
            asking = cells.pack(placed.join(bound, F.col("id") == F.col("i"), "left").drop("i"))

            def radius(q: dict, own: int) -> np.ndarray:
                """Centroid distance within which a nearer cluster can be; all, for one alone in its cell."""
                known = link.radius(q["radius"].astype(float)) * (1 + 1e-9) + 1e-12 * np.abs(q["x"]).max()
                return np.where(np.isnan(known), np.inf, known)

            best = best.union(cells.compare(cells.reach(asking, box, link.p, radius), held.select("cell", "p"),
                                            link.nearest, schema))
        nearest = cut_lineage(best.groupBy("id").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("e.*"))
        pairs = cut_lineage(nearest.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
                            .where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d"))
        if pairs.isEmpty():                                           # rounding parted two that chose each other
            pairs = cut_lineage(nearest.orderBy("d", "lo", "hi").limit(1).select(
                F.col("lo").alias("a"), F.col("hi").alias("b"), "d"))
        side = lambda s: now.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in "xwmv"])
        merged = pairs.join(side("a"), "a").join(side("b"), "b").select(
            F.col("a").alias("id"),
            F.zip_with("x_a", "x_b", lambda x, y: (x * F.col("w_a") + y * F.col("w_b")) / (F.col("w_a") + F.col("w_b")))
            .alias("x"), (F.col("w_a") + F.col("w_b")).alias("w"), F.concat("m_a", "m_b").alias("m"),
            F.concat("v_a", "v_b").alias("v"))
        gone = pairs.select(F.col("a").alias("i")).union(pairs.select("b"))
        now = cut_lineage(now.join(gone, F.col("id") == F.col("i"), "left_anti").select(*merged.columns).union(merged))
        found = found.union(pairs.withColumn("round", F.lit(turn)))
        n = now.count()
    rest = now.select("id", "x", "w").orderBy("id").collect()         # FEW rows at most
    names, w = [r["id"] for r in rest], np.array([r["w"] for r in rest], float)
    if not turn:                                                      # of single places
        tree = nn_chain(np.array([r["x"] for r in rest], float).reshape(len(rest), -1), w, link.name, link.p,
                        link.squared)
    else:
        numbers = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(names)], f"k {kind}, at bigint"))
        member = F.explode(F.sequence(F.lit(0), F.size("v") - 1)).alias("i")
        members = now.select("id", "m", "v", member).select(
            "id", F.slice("m", F.col("i") * width + 1, F.lit(width)).alias("x"), F.get("v", "i").alias("w"), "i")
        members = members.join(numbers, F.col("id") == F.col("k")).select(
            F.struct("id", "i").alias("id"), "at", "x", "w")
        D = _linkages(members, points, len(names), link)
        tree = _chain(D.copy() if link.name == "complete" else D / (w[:, None] * w[None, :]), w, link.name)
    last = []
    for k, (a, b, d, _) in enumerate(tree):
        lo, hi = sorted((names[int(a)], names[int(b)]))
        names.append(lo)
        last.append((lo, hi, float(d), turn + 1 + k))
    return found.union(spark.createDataFrame(last, f"a {kind}, b {kind}, d double, round int"))


# -- results ------------------------------------------------------------------

@dataclass
class HierarchyResult:
    labels: DataFrame          # (id, cluster)
    merges: DataFrame          # (step, height) in height order
    exact: bool


def _numbered(labels: DataFrame, id: str) -> DataFrame:
    """(id, cluster) from (id, root): clusters numbered by their smallest member, which is the root."""
    roots = global_rank(labels.select("root").distinct(), [F.col("root")], "cluster")
    return labels.join(roots.select(F.col("root").alias("r"), F.col("cluster").cast("int").alias("cluster")),
                       F.col("root") == F.col("r")).select(F.col("id").alias(id), "cluster")


def _cut_tree(rows: DataFrame, merges: DataFrame, n: int, n_clusters: int, id: str) -> HierarchyResult:
    """Labels from all but the last merges (a, b, d, round), and the merges' heights in order."""
    ranked = global_rank(merges, [F.col("d"), F.col("round"), F.col("a"), F.col("b")], "step")
    joined = connected_components(ranked.where(F.col("step") < n - n_clusters).select("a", "b"))
    labels = rows.select("id").join(joined, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id").alias("root"))
    return HierarchyResult(_numbered(labels, id), ranked.select(
        (F.col("step") + 1).cast("int").alias("step"), F.col("d").alias("height")), True)


def hierarchical(df: DataFrame, features: Sequence[str], n_clusters: int = 2,
                 linkage: str = "ward", id: str = "id", max_points: int | None = None,
                 seed: int = 42, approximate: bool = False, metric: str = "euclidean") -> HierarchyResult:
    """Agglomerative clustering, exact; see the module for each linkage.

    ``metric`` is one of ``METRICS``; ward takes euclidean distances only.
    ``max_points``, ``seed`` and ``approximate`` concern complete and average
    linkage: above ``max_points`` rows, where it is given, k-means clusters of
    them are merged if ``approximate``, and else it is an error.  Features must be numbers without nulls; ids must be unique.
    """
    linkage, metric = linkage.strip().lower(), metric.strip().lower()
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}; choose one of {LINKAGES}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    if linkage == "ward" and METRICS[metric] != 2.0 or linkage == "ward" and metric == "cosine":
        raise ValueError("ward linkage takes the euclidean metric only")
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [id])
    ship_package(df.sparkSession)
    x = F.array(*[as_double(c) + F.lit(0.0) for c in features])            # -0.0 and 0.0 are one place
    rows = cut_lineage(df.select(F.col(id).alias("id"), x.alias("x")))
    n, bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.exists("x", lambda v: v.isNull()), 1))).first()
    if bad:
        raise ValueError(f"{bad} rows have a missing feature")
    if n_clusters < 1 or n_clusters > n:
        raise ValueError(f"n_clusters={n_clusters} must be in [1, {n}]")
    if metric == "cosine":
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        if rows.where(size == 0).limit(1).count():
            raise ValueError("cosine distance is undefined for rows of zeros")
        rows = cut_lineage(rows.select("id", F.transform("x", lambda v: v / size).alias("x")))
    if linkage == "ward":
        return _cut_tree(rows, ward_merges(rows, len(features)), n, n_clusters, id)
    if linkage == "single":
        tree = minimum_spanning_tree(rows, len(features), METRICS[metric]).withColumn("round", F.lit(0))
        if metric == "cosine":                     # of unit vectors, half the square of the distance
            tree = tree.withColumn("d", F.col("d") * F.col("d") / 2)
        return _cut_tree(rows, tree, n, n_clusters, id)
    many = max_points is not None and n > max_points
    if many and not approximate:
        raise ValueError(f"{n} rows exceed max_points={max_points}; pass approximate=True "
                         "to cluster k-means micro-clusters instead")
    link = _Linkage(linkage, METRICS[metric], metric == "cosine")
    if many:
        return _condensed(rows, len(features), n_clusters, link, max_points, seed, id)
    keyed = global_rank(rows, [F.col("id")], "key")
    keyed = cut_lineage(keyed)
    merges = linked_merges(keyed.select(F.col("key").alias("id"), "x"), len(features), link)
    ranked = global_rank(merges, [F.col("d"), F.col("round"), F.col("a"), F.col("b")], "step")
    joined = connected_components(ranked.where(F.col("step") < n - n_clusters).select("a", "b"))
    roots = keyed.join(joined, F.col("key") == F.col("node"), "left").select(
        F.col("id").alias("_k"), F.coalesce("component", "key").alias("_root"))
    labels = rows.select(F.col("id").alias("_p"), "id").join(roots, F.col("_p") == F.col("_k")).select("id", "_root")
    return HierarchyResult(_named(labels, id), ranked.select(
        (F.col("step") + 1).cast("int").alias("step"), F.col("d").alias("height")), True)


def _named(labels: DataFrame, id: str) -> DataFrame:
    """(id, cluster) from (id, _root), clusters numbered by their smallest id."""
    first = labels.groupBy("_root").agg(F.min("id").alias("root")).withColumnRenamed("_root", "_r")
    return _numbered(labels.join(first, F.col("_root") == F.col("_r")).select("id", "root"), id)


def _condensed(rows: DataFrame, width: int, n_clusters: int, link: _Linkage, micro: int, seed: int,
               id: str) -> HierarchyResult:
    """Merges by the nearest-neighbour chain over ``micro`` k-means clusters of the rows."""
    from . import kmeans as km
    spark: SparkSession = rows.sparkSession
    names = [f"x{j}" for j in range(width)]
    flat = rows.select("id", *[F.col("x")[j].alias(c) for j, c in enumerate(names)])
    model = km.kmeans(flat, names, micro, "id", n_init=1, seed=seed, max_iter=20)
    a = cut_lineage(model.assign(flat, "id"))
    weight = {r["cluster"]: r["n"] for r in a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = sorted(weight)
    X, w = model.centers[keys], np.array([weight[k] for k in keys], dtype=float)
    point_of = a.select("id", F.col("cluster").alias("_p"))
    merges = nn_chain(X, w, link.name, link.p, link.squared)
    kind = point_of.schema["_p"].dataType.simpleString()
    roots = spark.createDataFrame([(k, int(r)) for k, r in zip(keys, cut(merges, len(X), n_clusters))],
                                  f"_k {kind}, _root long")
    labels = point_of.join(maybe_broadcast(roots, len(keys)), F.col("_p") == F.col("_k")).select("id", "_root")
    heights = spark.createDataFrame([(i + 1, float(h)) for i, h in enumerate(sorted(merges[:, 2]))],
                                    "step int, height double")
    return HierarchyResult(_named(labels, id), heights, False)
