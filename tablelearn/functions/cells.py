"""Exact neighbour work between boxes of points.

Points (id, x array<double>, further columns) are cut into cells: boxes of
about ``CELL_ROWS`` points that halve a sample again and again at the median
of its widest coordinate.  The sample only shapes the cells; every bound below
comes from the boxes that the points really fill, so results are exact.

A cell's points travel packed: one row holds a block of them as an array of
structs.  Two blocks meet by a join on the cell's number, and numpy compares
them in a task; pairs of points are never rows.  A cell that holds more than
its share is cut into several blocks by a hash, so a task's work has a bound.

Which other cells a point needs follows from a radius of its own (the distance
of the best found so far): those whose box is not further away.  ``reach``
compares a block's box with all boxes first, and its points with the few that
remain.  In few dimensions that leaves the neighbouring cells, so work grows
with the points; in many dimensions it may leave all.

The boxes are one row per cell, at most ``1 << MAX_DEPTH`` of them, and are
the only thing sent to the driver and to all tasks.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

CELL_ROWS = 1024
MAX_DEPTH = 14
SAMPLE_VALUES = 1 << 22          # numbers in the sample, at most
PER_CELL = 32                    # sampled points for each cell
PAIRS = 1 << 19                  # pairs of points that a task compares at once


@dataclasses.dataclass
class Splits:
    """A binary tree in heap order: which coordinate a node compares, and with what."""

    dim: np.ndarray
    cut: np.ndarray
    depth: int

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of ``x``."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def learn_splits(points: DataFrame, n: int, width: int, rows: int | None = None) -> Splits:
    """Splits for ``n`` points of ``width`` coordinates, about ``rows`` of them in a cell."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / (rows or CELL_ROWS)))))
    while depth and (PER_CELL << depth) * width > SAMPLE_VALUES:
        depth -= 1
    if not depth:
        return Splits(np.zeros(0, np.int64), np.zeros(0), 0)
    share = min(1.0, (PER_CELL << depth) / n)
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    x = np.array([r["x"] for r in some.select("x").collect()], float).reshape(-1, width)
    dim, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: x}
    for node in range(len(dim)):
        part = parts.pop(node)
        if len(part):
            dim[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            cut[node] = np.median(part[:, dim[node]])
        side = part[:, dim[node]] > cut[node]
        if 2 * node + 2 < len(dim):
            parts[2 * node + 1], parts[2 * node + 2] = part[~side], part[side]
    return Splits(dim, cut, depth)


def matrix(x: pa.ListArray) -> np.ndarray:
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 0)


def with_cell(points: DataFrame, splits: Splits, n: int, rows: int | None = None) -> DataFrame:
    """The ``n`` points with their ``cell`` and ``block``; written, if there is more than one block."""
    most = 2 * (rows or CELL_ROWS)                # of a block
    if not splits.depth and n <= most:
        return points.withColumns({"cell": F.lit(0).cast("bigint"), "block": F.lit(0).cast("bigint")})
    if splits.depth:
        ship_package(points.sparkSession)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = pa.array(splits.locate(matrix(b.column("x"))))
                    yield pa.RecordBatch.from_arrays([*b.columns, cell], names=[*b.schema.names, "cell"])

        schema = T.StructType([*points.schema.fields, T.StructField("cell", T.LongType())])
        points = cut_lineage(points.mapInArrow(run, schema))
    else:
        points = points.withColumn("cell", F.lit(0).cast("bigint"))
    counts = [(r["cell"], math.ceil(r["count"] / most))
              for r in points.groupBy("cell").count().collect()]              # a row per cell
    crowded = [c for c in counts if c[1] > 1]
    block = F.lit(0).cast("bigint")
    if crowded:
        parts = points.sparkSession.createDataFrame(crowded, "crowded bigint, parts bigint")
        points = points.join(F.broadcast(parts), F.col("cell") == F.col("crowded"), "left").drop("crowded")
        block = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0))
    return cut_lineage(points.withColumn("block", block).drop("parts"))


def pack(points: DataFrame) -> DataFrame:
    """(cell, block, p): each block's points as an array of structs of all other columns."""
    inner = [c for c in points.columns if c not in ("cell", "block")]
    return points.groupBy("cell", "block").agg(F.collect_list(F.struct(*inner)).alias("p"))


@dataclasses.dataclass
class Boxes:
    """What each cell's points fill, and the least and greatest of further columns; empty cells are infinitely far."""

    lo: np.ndarray
    hi: np.ndarray
    count: np.ndarray
    least: dict[str, np.ndarray]
    most: dict[str, np.ndarray]

    def gap(self, lo: np.ndarray, hi: np.ndarray, p: float, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Least distance of boxes (n x width, also points: lo = hi) from the cells: n x cells."""
        return _norm([np.maximum(0, np.maximum(self.lo[cells, j] - hi[:, j, None], lo[:, j, None] - self.hi[cells, j]))
                      for j in range(lo.shape[1])], p)

    def span(self, lo: np.ndarray, hi: np.ndarray, p: float, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Greatest distance of boxes from the cells; infinite from empty ones."""
        with np.errstate(invalid="ignore"):
            far = _norm([np.maximum(self.hi[cells, j] - lo[:, j, None], hi[:, j, None] - self.lo[cells, j])
                         for j in range(lo.shape[1])], p)
        far[:, self.count[cells] == 0] = np.inf
        return far


def _norm(parts: list[np.ndarray], p: float) -> np.ndarray:
    if math.isinf(p):
        return np.maximum.reduce(parts)
    total = sum(d ** p if p not in (1.0, 2.0) else d * d if p == 2.0 else d for d in parts)
    return np.sqrt(total) if p == 2.0 else total if p == 1.0 else total ** (1.0 / p)


def boxes(points: DataFrame, cells: int, width: int, extra: Sequence[str] = ()) -> Boxes:
    """Boxes of the points of a table with cells; a row per cell comes to the driver."""
    x = [F.col("x")[j] for j in range(width)]
    rows = points.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in x]).alias("lo"),
        F.array(*[F.max(c) for c in x]).alias("hi"),
        *[f(c).alias(f"{k}_{c}") for c in extra for k, f in (("least", F.min), ("most", F.max))]).collect()
    out = Boxes(np.full((cells, width), np.inf), np.full((cells, width), -np.inf), np.zeros(cells, np.int64),
                *({c: np.empty(cells, object) for c in extra} for _ in range(2)))
    for r in rows:
        out.lo[r["cell"]], out.hi[r["cell"]], out.count[r["cell"]] = r["lo"], r["hi"], r["n"]
        for c in extra:
            out.least[c][r["cell"]], out.most[c][r["cell"]] = r[f"least_{c}"], r[f"most_{c}"]
    return out


def fields(p: pa.StructArray) -> dict[str, np.ndarray]:
    """The columns of a block, ``x`` as a matrix; the block itself is under ``packed``."""
    return {f.name: matrix(p.field(i)) if f.name == "x" else p.field(i).to_numpy(zero_copy_only=False)
            for i, f in enumerate(p.type)} | {"packed": p}


def reach(blocks: DataFrame, box: Boxes, p: float, radius: Callable[[dict, np.ndarray], np.ndarray],
          wanted: Callable[[dict, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(cell, p): the points of each block that need another cell, with that cell's number.

    ``radius(points, own)`` gives each point's radius, ``own`` being the
    number of its cell; ``wanted(points, cells)`` a mask (points x cells) of
    cells worth looking at, if not all are.
    """
    told = blocks.sparkSession.sparkContext.broadcast(box)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = told.value
        for b in batches:
            for i in range(b.num_rows):
                own, packed = b.column(0)[i].as_py(), b.column(1)[i].values
                pts = fields(packed)
                x, far = pts["x"], radius(pts, own)
                gap = box.gap(x.min(axis=0)[None], x.max(axis=0)[None], p)[0]
                near = np.flatnonzero((gap <= far.max()) & (box.count > 0) & (np.arange(len(gap)) != own))
                for part in np.array_split(near, len(near) * len(x) // PAIRS + 1):
                    hit = box.gap(x, x, p, part) <= far[:, None]
                    if wanted and len(part):
                        hit &= wanted(pts, part)
                    for k in np.flatnonzero(hit.any(axis=0)):
                        some = packed.take(pa.array(np.flatnonzero(hit[:, k])))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part[k]], pa.int64()),
                             pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names=["cell", "p"])

    kind = blocks.schema["p"].dataType.simpleString()
    return blocks.select("cell", "p").mapInArrow(run, f"cell bigint, p {kind}")


def compare(asking: DataFrame, held: DataFrame, fn: Callable[[dict, dict], list],
            schema: list[tuple[str, str]], write: bool = True) -> DataFrame:
    """Rows of ``fn(points, others)`` for each block of ``asking`` with each block of ``held`` in its cell.

    ``asking`` and ``held`` have (cell, p); ``fn`` returns arrays, one for
    each column of ``schema`` (names and types).  It gets a block's points in
    slices of about ``PAIRS`` pairs, so what it may reduce over the points is
    reduced again by the caller.  Both sides are shuffled: what
    ``reach`` gives is many times the table its size is guessed from, and a
    broadcast of either side would pass it whole through the driver.
    """
    ship_package(asking.sparkSession)
    pairs_held = PAIRS
    pairs = asking.select("cell", F.col("p").alias("q")).hint("merge").join(
        held.select(F.col("cell").alias("other"), F.col("p").alias("r")).hint("merge"), F.col("cell") == F.col("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, r = b.column(0)[i].values, fields(b.column(1)[i].values)
                step = max(1, pairs_held // max(1, len(r["packed"])))
                for lo in range(0, len(q), step):
                    columns = fn(fields(q.slice(lo, step)), r)
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays(
                            [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                            names=[f"_{j}" for j in range(len(columns))])

    kinds = ", ".join(f"_{j} {kind}" for j, (_, kind) in enumerate(schema))
    out = pairs.select("q", "r").mapInArrow(run, kinds).toDF(*[name for name, _ in schema])
    return cut_lineage(out) if write else out
