"""Connected components of an edge table, by rounds of star contraction.

Each round first hangs every node's larger neighbours, then its smaller ones,
on the smallest neighbour that it knows, and writes the edges to the
checkpoint folder.  Nodes move towards their component's smallest one in a
number of rounds logarithmic in the longest path, and no table ever holds more
than twice the edges.  All shuffles are equi-joins and grouped minima, so that
a component of any size is spread over tasks: a hub meets its neighbours in
a join that Spark can split, never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of distinct edges: equal if the tables are."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hang(pairs: DataFrame, keep: str) -> DataFrame:
    """Edges (v, m) from the neighbours v of each u to the smallest node m among u and its neighbours."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return (pairs.join(low, F.col("u") == F.col("w")).where(keep)
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another one; component is its smallest node.

    ``edges`` has two columns of one orderable type without nulls; direction,
    repeats and loops don't matter.
    """
    u, v = edges.columns
    now = cut_lineage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct())
    seen, done = None, _state(now)
    while done[0] and done != seen:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, "v > u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        now = cut_lineage(_hang(large, "v > m").union(low).distinct())
        seen, done = done, _state(now)
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("u"), "v").distinct()))
