"""Approximate nearest neighbours with learned partitions.

1. A sample of at most some ``SAMPLE`` rows, drawn by a hash, gives an exact
   neighbour graph.
2. The graph is cut into balanced parts with few edges between them: halving
   along principal directions to start with, then moves of single rows to the
   part that holds most of their neighbours, within the balance.
3. A small classifier (softmax regression) learns the part from the vector.
   It puts every row into its most probable part, and routes a query to the
   most probable ones.
4. How many parts a query probes is measured: for ``TUNE`` sampled queries the
   true neighbours among all rows are found by brute force (one pass over the
   rows), and the fewest probes that reach ``RECALL`` of them are used.
5. The candidates of the probed parts are reranked by the inner product in
   double precision.

A part's rows and queries are cut into blocks by a hash, and each pair of
blocks is a task's work of its own, so a part of any size is spread over many
tasks.  Only sampled rows and the model come to the driver; their size doesn't
depend on the table's.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another length than the
commonest; ties go to the smaller id, a null id last; rows with one id are
rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Scratch, map_batches, take
from .emb_dedup import pack, to_matrix

SAMPLE = 4096
MAX_PARTS = 64
GRAPH_K = 10
SWEEPS = 8
SLACK = 1.1              # a part of the sample holds at most so many times the mean
STEPS, RATE = 300, 0.05
TUNE = 96
RECALL = 0.97
ROW_BLOCK, QUERY_BLOCK = 4096, 1024


def unpack(packed, dim: int) -> np.ndarray:
    x = [np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in packed]
    return np.stack(x).astype(np.float64) if x else np.zeros((0, dim))


def parts_for(rows: int) -> int:
    """Number of parts: about the square root of the rows over 8, a power of 2."""
    return int(min(MAX_PARTS, 2 ** max(0, round(math.log2(max(1.0, math.sqrt(rows) / 8))))))


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Each row's k rows with the largest inner products, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo:lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        if k > 0:
            out[lo:lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row; no part above SLACK times the mean."""
    part = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:                              # halve every part at its median
        for p in range(n):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                y = x[at] - x[at].mean(0)
                _, v = np.linalg.eigh(y.T @ y)
                part[at[np.argsort(y @ v[:, -1], kind="stable")[len(at) // 2:]]] = p + n
        n *= 2
    most = math.ceil(SLACK * len(x) / parts)
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    dst = graph.reshape(-1)
    size = np.bincount(part, minlength=parts)
    for _ in range(SWEEPS):
        held = np.zeros((len(x), parts))          # edges of each row into each part
        np.add.at(held, (src, part[dst]), 1)
        np.add.at(held, (dst, part[src]), 1)
        own = held[np.arange(len(x)), part]
        goal = held.argmax(1)
        gain = held.max(1) - own
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())].tolist():
            if size[goal[i]] < most:
                size[part[i]] -= 1
                size[goal[i]] += 1
                part[i] = goal[i]
                moved += 1
        if not moved:
            break
    return part


@dataclasses.dataclass
class Router:
    """Softmax regression from vector to part."""
    weights: np.ndarray
    bias: np.ndarray
    dim: int
    parts: int
    probes: int = 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts of each row, the most probable first."""
        return np.argsort(-(_scaled(x) @ self.weights + self.bias), axis=1, kind="stable")


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def train_router(x: np.ndarray, parts: int, dim: int) -> Router:
    if parts <= 1 or len(x) < 2:
        return Router(np.zeros((dim, 1)), np.zeros(1), dim, 1)
    part = balanced_parts(x, neighbour_graph(x), parts)
    y, goal = _scaled(x), np.eye(parts)[part]
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, STEPS + 1):              # Adam on the whole sample
        z = y @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - goal) / len(y)
        for k, (param, g) in enumerate(((w, y.T @ d + 1e-5 * w), (b, d.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            param -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return Router(w, b, dim, parts)


def top(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, score) of each query's k best rows; ``own``: a query's place among the rows or -1.

    The products of a block pick the rows; the scores are summed the same way
    for every pair, so that equal vectors score the same wherever they lie.
    """
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    s = queries @ rows.T
    some = np.flatnonzero(own >= 0)
    s[some, own[some]] = -np.inf
    take_ = min(k, len(rows))
    edge = -np.partition(-s, take_ - 1, axis=1)[:, take_ - 1:take_]
    slack = 1e-9 * np.maximum(1.0, np.abs(edge))
    q, r = np.nonzero((s >= np.where(np.isfinite(edge), edge - slack, -np.inf)) & (s > -np.inf))
    exact = np.empty(len(q))
    for lo in range(0, len(q), 1 << 16):
        exact[lo:lo + (1 << 16)] = (queries[q[lo:lo + (1 << 16)]] * rows[r[lo:lo + (1 << 16)]]).sum(1)
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], r[nth < k], exact[nth < k]


def _id_key(ids: pd.Series) -> np.ndarray:
    """Ids as numbers to break ties with, null last."""
    return ids.fillna(np.iinfo(np.int64).max).astype(np.int64).to_numpy()


def search(df: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
           recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` rows found nearest to each query.

    ``queries`` says of a row of ``id`` whether it is a query; ids are whole
    numbers.  Nearness is the inner product of the original vectors.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    rows = (take(df, **{id: id, "_vec": vector}).withColumn("is_query", F.coalesce(queries, F.lit(False)))
            .select(F.col(id).cast("long").alias("id"), "is_query", "_vec")
            .withColumn("node", F.monotonically_increasing_id()))

    def clean(columns: list[pa.Array]) -> list[pa.Array]:
        found = to_matrix(columns[3])
        keep = [i for i, v in enumerate(found) if v is not None]
        at = pa.array(keep, pa.int64())
        return [columns[2].take(at), columns[0].take(at), columns[1].take(at),
                pa.array([len(found[i]) for i in keep], pa.int32()),
                pa.array([pack(found[i]) for i in keep], pa.binary())]

    good = scratch.write(map_batches(rows.select("id", "is_query", "node", "_vec"), clean, [
        ("node", "long"), ("id", "long"), ("is_query", "boolean"), ("dim", "int"), ("vec", "binary")]))
    empty = "query_id long, rank int, vec_id long, score double"
    shape = good.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], empty)
    dim, n = shape["dim"], shape["count"]
    good = good.where(F.col("dim") == dim)
    draw = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    sample = good.where(draw < min(1.0, SAMPLE / n)).select("node", "vec").orderBy("node").limit(2 * SAMPLE).collect()
    router = train_router(unpack([r.vec for r in sample], dim), parts_for(n), dim)
    shared = spark.sparkContext.broadcast(router)

    def place(columns: list[pa.Array]) -> list[pa.Array]:
        order = shared.value.order(unpack(columns[3].to_pylist(), dim))
        return [*columns, pa.array(order[:, 0].astype(np.int32)),
                pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))]

    index = scratch.write(map_batches(good.select("node", "id", "is_query", "vec"), place, [
        ("node", "long"), ("id", "long"), ("is_query", "boolean"), ("vec", "binary"), ("part", "int"),
        ("route", "array<int>")]))
    probes = _tune(spark, index, sample[:: max(1, len(sample) // TUNE)][:TUNE], router, n, k, recall)

    # a query whose first parts hold too few rows goes on until they hold k besides its own, or to all
    held = dict(index.groupBy("part").count().collect())                # a row per part, MAX_PARTS at most
    sizes = F.array(*[F.lit(held.get(i, 0)).cast("long") for i in range(router.parts)])
    start = F.struct(F.lit(0).alias("parts"), F.lit(0).cast("long").alias("rows"))
    reach = F.aggregate("route", start, lambda a, part: F.when(a["rows"] > k, a).otherwise(F.struct(
        (a["parts"] + 1).alias("parts"), (a["rows"] + F.get(sizes, part)).alias("rows"))))
    # blocks of each part's rows, and of the queries that probe it
    wanted = index.where("is_query").select("node", "id", "vec", F.explode(
        F.slice("route", F.lit(1), F.greatest(F.lit(probes), reach["parts"]))).alias("part"))
    cut = (index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("rb"))
           .join(wanted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb")), "part"))
    cut = F.broadcast(cut)                       # a row per part, MAX_PARTS at most
    own = lambda name, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = (index.select("node", "id", "vec", "part").join(cut, "part").withColumn("i", own("rb", 2))
            .withColumn("j", every("qb")).withColumn("query", F.lit(False)))
    right = (wanted.join(cut, "part").withColumn("j", own("qb", 3))
             .withColumn("i", every("rb")).withColumn("query", F.lit(True)))
    cols = ["part", "i", "j", "query", "node", "id", "vec"]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        a, q = pdf[~pdf["query"]], pdf[pdf["query"]]
        nodes, mine = a["node"].to_numpy(), q["node"].to_numpy()
        at = np.minimum(np.searchsorted(nodes, mine), max(len(nodes) - 1, 0))
        here = np.where(nodes[at] == mine, at, -1) if len(nodes) else np.full(len(mine), -1)
        qi, ri, score = top(unpack(q["vec"], dim), unpack(a["vec"], dim), here, _id_key(a["id"]), k)
        return pd.DataFrame({"query": mine[qi], "query_id": q["id"].to_numpy()[qi],
                             "vec_id": a["id"].astype("Int64").to_numpy()[ri], "score": score})

    found = left.select(*cols).union(right.select(*cols)).groupBy("part", "i", "j").applyInPandas(
        near, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _tune(spark, index: DataFrame, sample: list, router: Router, n: int, k: int, recall: float) -> int:
    """The fewest probes with which the sampled queries find ``recall`` of their true neighbours."""
    if router.parts == 1 or not sample:
        return 1
    q = unpack([r.vec for r in sample], router.dim)
    nodes = np.array([r.node for r in sample])
    rank = np.argsort(router.order(q), axis=1)          # place of each part in a query's order
    shared = spark.sparkContext.broadcast((q, nodes))
    dim = router.dim

    def best(columns: list[pa.Array]) -> list[pa.Array]:
        q, nodes = shared.value
        mine, part = columns[0].to_numpy(), columns[2].to_numpy()
        order = np.argsort(mine)
        mine, part = mine[order], part[order]
        x = unpack([columns[1][int(i)].as_py() for i in order], dim)
        at = np.minimum(np.searchsorted(mine, nodes), len(mine) - 1)
        qi, ri, score = top(q, x, np.where(mine[at] == nodes, at, -1), mine, k)
        return [pa.array(qi), pa.array(part[ri]), pa.array(score)]

    each = map_batches(index.select("node", "vec", "part"), best,
                       [("q", "long"), ("part", "int"), ("score", "double")])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "part")
    true = (each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            .groupBy("q", "part").count().collect())    # TUNE x k rows at most
    need = np.zeros(router.parts)
    for r in true:
        need[rank[r.q, r.part]] += r["count"]
    reached = np.cumsum(need) / max(1.0, need.sum())
    return int(min(router.parts, np.searchsorted(reached, recall) + 1))
