"""Distributed union-find: connected components by large-star and small-star rounds.

Every round rewires the edges towards smaller nodes and writes them as a table
in the shared checkpoint folder, which cuts the lineage.  The number of edges
never grows beyond twice the input's, and the rounds grow with the logarithm
of the longest path.  The loop ends when a round changes nothing.  A hub's
edges are aggregated before the shuffle, and the joins are plain equi-joins,
so that Spark can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _print(edges: DataFrame) -> tuple:
    """Count and checksum of a table of distinct edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node.

    ``edges`` has columns ``u`` and ``v`` of one orderable type without null;
    direction, repeats and loops don't matter.  A node that has only a loop is
    in no edge and doesn't come back.
    """
    e = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u <> v").distinct())
    seen = _print(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (both.join(least, both["u"] == least["w"]).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        roots = lower.select(F.col("u").alias("w"), F.col("m"))
        small = (large.join(roots, large["u"] == roots["w"]).where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower).distinct())
        old, e = e, scratch.write(small)
        scratch.drop(old)
        now = _print(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = nodes.union(roots)
    out._scratch_path = getattr(e, "_scratch_path", None)
    return out
