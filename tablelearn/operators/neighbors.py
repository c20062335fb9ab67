"""Exact k-nearest-neighbour search (Minkowski p) between two tables.

References are packed into cells (``functions.cells``).  Every query first
meets the references of its own cell, which gives a bound for its kth
distance, and then those of the cells whose box lies inside that bound; a
window per query keeps the best.  In few dimensions a query meets a handful
of cells, however many there are, so the work grows with the rows; in many
dimensions bounds say little and it may meet all of them.

References that share a place are cut to the k smallest ids, since no query
needs more of them, so a place that holds a third of all rows costs no more
than others.  Ties: rounded distance, then reference id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import as_double
from ..functions import cells
from ..functions.distance import minkowski
from ..session import cut_lineage, ship_package

WIDE = 8             # coordinates from which blocks are compared by products first
SLACK = 2e-9         # on distances: two that round alike differ by less
DIGITS = 9   # distances are ranked after rounding (engine-independent ties)


def top_k_order(dr: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Column indices of the m smallest (dr, id) per row, in that order.

    ``argpartition`` picks candidates in O(n); rows whose m-th value is tied
    with values left outside are re-ranked exactly by (value, id).
    """
    n_rows, n_cols = dr.shape
    if m >= n_cols:
        return np.lexsort((np.broadcast_to(ids, dr.shape), dr), axis=1)[:, :m]
    part = np.argpartition(dr, m - 1, axis=1)[:, :m]
    kth = np.take_along_axis(dr, part, axis=1).max(axis=1)
    n_le = (dr <= kth[:, None]).sum(axis=1)
    out = np.empty((n_rows, m), dtype=np.int64)
    for i in range(n_rows):
        if n_le[i] > m:       # ties at the boundary: resolve by id
            cand = np.flatnonzero(dr[i] <= kth[i])
            o = np.lexsort((ids[cand], dr[i, cand]))[:m]
            out[i] = cand[o]
        else:
            cand = part[i]
            o = np.lexsort((ids[cand], dr[i, cand]))
            out[i] = cand[o]
    return out


def block_top_k(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest columns of each row, by (rounded distance, id), and their distances.

    Wide euclidean blocks take their candidates from the product form, whose
    rounding error has a bound; only rows for which that leaves doubt are
    compared with every column.
    """
    m, spare = min(k, len(r)), min(len(r), 2 * k + 16)
    if p != 2.0 or q.shape[1] < WIDE or spare == len(r):
        d = minkowski(q, r, p)
        order = top_k_order(np.round(d, DIGITS), ids, m)
        return order, np.take_along_axis(d, order, axis=1)
    middle = r.mean(axis=0)
    a, b = q - middle, r - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    error = 4e-16 * (q.shape[1] + 8) * (aa + bb.max())
    near = np.argpartition(rough, spare - 1, axis=1)[:, :spare]
    edge = np.take_along_axis(rough, near, axis=1).max(axis=1) - error          # all others are as far, squared
    gap = q[:, None, :] - r[near]
    d = np.sqrt((gap * gap).sum(axis=2))
    order = np.lexsort((ids[near], np.round(d, DIGITS)), axis=1)[:, :m]
    d, order = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
    doubt = np.flatnonzero((d[:, -1] + SLACK) ** 2 >= edge)
    for part in np.array_split(doubt, len(doubt) // 256 + 1):
        full = minkowski(q[part], r, p)
        best = top_k_order(np.round(full, DIGITS), ids, m)
        order[part], d[part] = best, np.take_along_axis(full, best, axis=1)
    return order, d


def _points(df: DataFrame, features: Sequence[str], id: str, payload: Sequence[str] = ()) -> tuple[DataFrame, int]:
    x = F.array(*[as_double(c) + F.lit(0.0) for c in features])
    out = df.select(F.col(id).alias("id"), x.alias("x"), *[F.col(c).alias(f"y_{c}") for c in payload])
    n, bad = out.agg(F.count(F.lit(1)), F.count(F.when(F.exists("x", lambda v: v.isNull()), 1))).first()
    if bad:
        raise ValueError(f"{bad} rows have a missing feature; impute or drop them first")
    return out, n


def _certain(known: np.ndarray, x: np.ndarray, box: cells.Boxes, full: np.ndarray, p: float) -> np.ndarray:
    """The kth distances so far; where fewer were found, one that reaches a ``full`` cell for certain."""
    bare = np.flatnonzero(np.isnan(known))
    for part in np.array_split(bare, len(bare) * len(full) // (1 << 22) + 1):
        if len(part):
            known[part] = box.span(x[part], x[part], p, full).min(axis=1) if len(full) else np.inf
    return known + SLACK


def knn(queries: DataFrame, refs: DataFrame, features: Sequence[str], k: int = 5,
        p: float = 2.0, qid: str = "id", rid: str = "id", payload: Sequence[str] = (),
        block_rows: int | None = None, of: int | None = None) -> DataFrame:
    """(q, r, dist, rank, payload...): the k nearest references of each query
    (rank 1 = nearest).  Missing features are an error; ``block_rows`` is about
    how many rows a cell holds.  With ``of`` the features stand for so many:
    euclidean squares are scaled up by ``of`` / their number."""
    ship_package(queries.sparkSession)
    features, payload, k, p = list(features), list(payload), int(k), float(p)
    if of and p != 2.0:
        raise ValueError("of needs p = 2")
    scale = math.sqrt(of / len(features)) if of else 1.0
    q, nq = _points(queries, features, qid)
    r, nr = _points(refs, features, rid, payload)
    schema = [("q", q.schema["id"].dataType.simpleString()), ("r", r.schema["id"].dataType.simpleString()),
              ("dist", "double"), *[(c, r.schema[f"y_{c}"].dataType.simpleString()) for c in payload]]

    def nearest(a: dict, b: dict) -> list:
        if of:
            square = sum((a["x"][:, j, None] - b["x"][None, :, j]) ** 2 for j in range(len(features)))
            d = np.sqrt(square * of / len(features))
            order = top_k_order(np.round(d, DIGITS), b["id"], min(k, d.shape[1]))
            d = np.take_along_axis(d, order, axis=1)
        else:
            order, d = block_top_k(a["x"], b["x"], b["id"], k, p)
        rows, cols = pa.array(np.repeat(np.arange(len(d)), d.shape[1])), pa.array(order.ravel())
        asking, held = a["packed"], b["packed"]
        return [asking.field("id").take(rows), held.field("id").take(cols), d.ravel(),
                *[held.field(f"y_{c}").take(cols) for c in payload]]

    splits = cells.learn_splits(r, nr, len(features), block_rows)
    if splits.depth:                # of references in one place only k can be anyone's nearest
        again = F.row_number().over(Window.partitionBy("x").orderBy("id"))
        r = r.withColumn("_again", again).where(F.col("_again") <= k).drop("_again")
    r, q = cells.with_cell(r, splits, nr, block_rows), cells.with_cell(q, splits, nq, block_rows)
    held, asking = cells.pack(r), cells.pack(q)
    if not splits.depth:
        found = cells.compare(asking, held, nearest, schema, write=False)
    else:
        held = cut_lineage(held)
        found = cells.compare(asking, held, nearest, schema)
        box = cells.boxes(r, 1 << splits.depth, len(features))
        full = np.flatnonzero(box.count >= k)
        bound = found.groupBy(F.col("q").alias("i")).agg(F.sort_array(F.collect_list("dist")).alias("d")).select(
            "i", F.get("d", F.lit(k - 1)).alias("radius"))

        def radius(a: dict, own: int) -> np.ndarray:
            known = a["radius"].astype(float)
            return _certain(known / scale * (1 + 1e-12) if of else known, a["x"], box, full, p)

        wanting = cells.pack(q.join(bound, F.col("id") == F.col("i"), "left").drop("i"))
        found = found.union(cells.compare(cells.reach(wanting, box, p, radius), held, nearest, schema))
    w = Window.partitionBy("q").orderBy(F.round("dist", DIGITS), F.col("r"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_problems(rows: DataFrame, features: Sequence[str], label: str, k: int, sizes: Sequence[int], parts: int,
                 at: str, p: float = 2.0, id: str = "id", train: bool = False,
                 block_rows: int | None = None) -> DataFrame:
    """Neighbours for many training sets of one table in a single search.

    ``at`` holds for each of ``parts`` parts (folds) a row's position in the
    part's training rows by ascending id, or -1 if the row is its test row.
    Problem (part, size) has the rows at positions below ``sizes[size]`` as
    references; its test rows ask and, with ``train``, its references too.

    (q, part, size, seen, y, r, dist, lab, rank): ``seen`` marks a reference
    that asks, ``y`` and ``lab`` are the labels of both.  Each distance is
    computed once, whatever the number of problems; a query's radius is the
    greatest of its problems.
    """
    ship_package(rows.sparkSession)
    features, k, p, parts = list(features), int(k), float(p), int(parts)
    sizes = np.asarray(list(sizes), np.int64)
    pts, n = _points(rows, features, id, [label, at])
    pts = pts.toDF("id", "x", "y", "at")
    kinds = {c: pts.schema[c].dataType.simpleString() for c in ("id", "y")}
    schema = [("q", kinds["id"]), ("part", "int"), ("size", "int"), ("seen", "boolean"), ("y", kinds["y"]),
              ("r", kinds["id"]), ("dist", "double"), ("lab", kinds["y"])]

    def nearest(a: dict, b: dict) -> list:
        asking, held = a["packed"], b["packed"]
        by = np.argsort(b["id"], kind="stable")
        place, ref = cells.matrix(asking.field("at")), cells.matrix(held.field("at"))[by]
        dist = minkowski(a["x"], b["x"][by], p)
        order = np.argsort(np.round(dist, DIGITS), axis=1, kind="stable")
        found = []
        for f in range(parts):
            for s, size in enumerate(sizes):
                who = np.flatnonzero(place[:, f] < (size if train else 0))
                hit = ((ref[:, f] >= 0) & (ref[:, f] < size))[order[who]]
                hit &= np.cumsum(hit, axis=1) <= k
                i, j = np.nonzero(hit)
                found.append((who[i], order[who[i], j], np.full(len(i), f), np.full(len(i), s)))
        i, j, f, s = (np.concatenate(c) for c in zip(*found, strict=True))
        one, other = pa.array(i), pa.array(by[j])
        return [asking.field("id").take(one), f.astype(np.int32), s.astype(np.int32), place[i, f] >= 0,
                asking.field("y").take(one), held.field("id").take(other), dist[i, j], held.field("y").take(other)]

    splits = cells.learn_splits(pts, n, len(features), block_rows)
    refs = pts
    if splits.depth:                # of one part's rows in one place only k can be anyone's nearest
        own = F.array_position("at", F.lit(-1).cast("bigint"))
        again = F.row_number().over(Window.partitionBy("x", own).orderBy("id"))
        refs = refs.withColumn("_again", again).where(F.col("_again") <= k).drop("_again")
    refs, asks = cells.with_cell(refs, splits, n, block_rows), cells.with_cell(pts, splits, n, block_rows)
    held, asking = cells.pack(refs), cells.pack(asks)
    if not splits.depth:
        found = cells.compare(asking, held, nearest, schema, write=False)
    else:
        held = cut_lineage(held)
        found = cells.compare(asking, held, nearest, schema)
        box = cells.boxes(refs, 1 << splits.depth, len(features))
        least = F.least(*[F.count_if((F.col("at")[f] >= 0) & (F.col("at")[f] < int(sizes.min())))
                          for f in range(parts)])
        full = np.array(sorted(r["cell"] for r in refs.groupBy("cell").agg(least.alias("n")).where(
            F.col("n") >= k).select("cell").collect()), np.int64)              # a row per cell, at most
        kth = F.get(F.sort_array(F.collect_list("dist")), F.lit(k - 1))
        bound = (found.groupBy("q", "part", "size").agg(kth.alias("d")).groupBy(F.col("q").alias("i"))
                 .agg(F.max("d").alias("radius"), F.count("d").alias("done")))

        def radius(a: dict, own: int) -> np.ndarray:
            place = cells.matrix(a["packed"].field("at"))[:, :, None]
            open_ = (place < (sizes if train else 0)).sum(axis=(1, 2)) * (1 if train else len(sizes))
            known = np.where(a["done"].astype(float) == open_, a["radius"].astype(float), np.nan)
            return _certain(known, a["x"], box, full, p)

        wanting = cells.pack(asks.join(bound, F.col("id") == F.col("i"), "left").drop("i"))
        found = found.union(cells.compare(cells.reach(wanting, box, p, radius), held, nearest, schema))
    w = Window.partitionBy("q", "part", "size").orderBy(F.round("dist", DIGITS), F.col("r"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
