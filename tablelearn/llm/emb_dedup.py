"""Near-duplicate embeddings by random-hyperplane signs, exact cosine, components.

Vectors are compared only within a label and with vectors of their own
length.  In each of several tables a vector falls into a bucket by the signs
of its products with random hyperplanes.  The number of hyperplanes of a table
follows the number of vectors with the commonest label, so that a bucket of
unrelated vectors holds about ``BUCKET`` rows at any size; the number of tables
follows from it and ``MISS``, the chance that a pair at the threshold shares no
bucket.

The pairs of a bucket are compared in numpy, in blocks of at most ``BLOCK``
rows a side, with cosines in double precision.  A large bucket is cut into
blocks by a hash, and each pair of blocks is a task's work of its own; no pair
is ever a row.  A pair that meets in several tables counts in the first one
only, which both sides' signs tell.  A task returns how many links each vector
has and which local component it is in, and distributed union-find joins
those.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; equal vectors link
like any others; rows with one id are vectors of their own; a null id links
too, but names its component only if no other row does; an empty table gives
an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Scratch, map_batches, take
from .components import components

THRESHOLD = 0.93
MISS = 1e-6
BUCKET = 256
BLOCK = 1024
SEED = 20_061


def layout(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(hyperplanes of a table, tables) for this many vectors with one label."""
    bits = max(4, min(62, math.ceil(math.log2(max(largest, 1) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def to_matrix(lists: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision, None if it takes no part."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = [None] * len(lists)
    flat = lists.flatten()
    ok = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ok &= np.isfinite(values)
    at = 0
    sizes = lists.value_lengths().to_pylist()
    for i, n in enumerate(sizes):
        if not valid[i]:
            continue
        v = values[at:at + n]
        if n and ok[at:at + n].all() and v.any():
            out[i] = v
        at += n
    return out


def pack(v: np.ndarray) -> bytes:
    """A vector's components, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return (short if (short == v).all() else v).tobytes()


def unit_rows(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in packed])
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links_of_block(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float):
    """(rows, counts, edges) of the pairs of two blocks, or of one with itself.

    Edges join rows of a local component; left rows come first.
    """
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    x = unit_rows(list(rows["vec"]), int(rows["dim"].iloc[0]))
    signs = np.stack(list(rows["keys"]))
    n = len(left)
    a, b = (slice(0, n), slice(0, n)) if right is None else (slice(0, n), slice(n, len(rows)))
    near = x[a] @ x[b].T >= threshold
    if right is None:
        near &= ~np.eye(n, dtype=bool)
    i, j = np.nonzero(near)
    if right is not None:
        j = j + n
    # a pair belongs to the first table in which it meets
    fresh = ~(signs[i, :table] == signs[j, :table]).any(1) if table else np.ones(len(i), bool)
    i, j = i[fresh], j[fresh]
    counts = np.bincount(i, minlength=len(rows))
    if right is not None:
        counts += np.bincount(j, minlength=len(rows))
    part = np.arange(len(rows))
    while True:                                   # smallest row number among linked rows
        new = part.copy()
        np.minimum.at(new, i, part[j])
        np.minimum.at(new, j, part[i])
        new = new[new]
        if (new == part).all():
            return rows, counts, part
        part = new


def _bucket_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within one pair of blocks of a bucket: (id, n, other)."""
    table = int(pdf["tab"].iloc[0])
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    left = pdf[pdf["side"] == 0]
    right = pdf[pdf["side"] == 1]
    if int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0]):
        rows, counts, part = _links_of_block(left, None, table, threshold)
    elif len(left) and len(right):
        rows, counts, part = _links_of_block(left, right.reset_index(drop=True), table, threshold)
    else:
        rows, counts, part = pdf[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = counts > 0
    node = rows["node"].to_numpy()
    return pd.DataFrame({"node": node[hit], "n": counts[hit], "other": node[part[hit]]})


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` for each row.

    ``n_links`` counts the other rows with the same label and a cosine of at
    least ``threshold``; ``component_id`` is the smallest id reachable by links.
    """
    ship_package(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(take(df, id=id, vec=vector, label=label)
                         .withColumn("node", F.monotonically_increasing_id()))
    group = rows.where("label is not null").groupBy("label", F.size("vec").alias("dim"))
    largest = group.count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(largest, threshold)

    def sign(columns: list[pa.Array]) -> list[pa.Array]:
        found = to_matrix(columns[1])
        keep = [i for i, v in enumerate(found) if v is not None]
        dims = np.array([len(found[i]) for i in keep], np.int32)
        packed = [pack(found[i]) for i in keep]
        signs = np.zeros((len(keep), tables), np.int64)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            side = unit_rows([packed[k] for k in at], d) @ hyperplanes(d, bits, tables) > 0
            signs[at] = side.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        kept = pa.array(keep, pa.int64())
        keys = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * tables,
                                        pa.array(signs.reshape(-1)))
        return [columns[0].take(kept), columns[2].take(kept), pa.array(dims),
                pa.array(packed, pa.binary()), keys]

    label_type = dict(rows.dtypes)["label"]
    vectors = scratch.write(map_batches(
        rows.where("label is not null").select("node", "vec", "label"), sign,
        [("node", "long"), ("label", label_type), ("dim", "int"), ("vec", "binary"), ("keys", "array<long>")]))
    bucket = ["label", "dim", "tab", "key"]
    member = vectors.select("node", "label", "dim", F.posexplode("keys").alias("tab", "key"))
    sizes = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = (member.join(sizes, bucket).withColumn("blocks", blocks)
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # each row goes to the pairs of its block with every block of its bucket
    pairs = (placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", *bucket, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                     F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side")))
    full = pairs.join(vectors.select("node", "vec", "keys"), "node")
    found = scratch.write(full.groupBy(*bucket, "i", "j").applyInPandas(
        lambda pdf: _bucket_links(pdf, threshold), "node long, n long, other long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))

    parts = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")), scratch)
    scratch.drop(vectors)
    out = (rows.select("node", "id").join(links, "node", "left").join(parts, "node", "left")
           .withColumn("component", F.coalesce("component", "node")))
    least = out.groupBy("component").agg(F.min("id").alias("component_id"))
    return out.join(least, "component").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
