"""Global ranking and cumulative sums without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
Here the rows are range-partitioned on the whole order key and sorted inside
their partitions, and written as a table in the shared checkpoint folder with
a number that holds partition and place.  A row's rank is its place plus the
number of rows in earlier partitions: one small row per partition, joined by
broadcast.  Because the numbered rows are written, a lost executor can't
change a rank, and the input is read once.

The order must be total (end it with a unique id); a value that many rows
share is then spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_ROWS = 100_000
PLACE_BITS = 33        # monotonically_increasing_id: partition, then 33 bits of place


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                sums: dict[str, Column] | None = None,
                buckets: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ascending ``order``.

    ``order`` must be a total order (end it with a unique id); for a
    descending numeric key pass its negation.  ``sums`` maps output names to
    expressions whose running total (inclusive, in ``order``) is added.
    """
    sums = sums or {}
    spark = df.sparkSession
    nb = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order))]
    ranged = (df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
              .repartitionByRange(nb, *keys).sortWithinPartitions(*keys).drop(*keys))
    placed = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_b", F.shiftright("_m", PLACE_BITS))
    per = placed.groupBy("_b").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(e).alias(f"_s_{k}") for k, e in sums.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # a row per partition
    offsets = per.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *[F.sum(f"_s_{k}").over(before).alias(f"_o_{k}") for k in sums])
    out = placed.join(F.broadcast(offsets), "_b").withColumn(
        name, (F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).cast("bigint"))
    inside = Window.partitionBy("_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k, e in sums.items():
        out = out.withColumn(k, F.coalesce(F.col(f"_o_{k}") + F.sum(e).over(inside), F.sum(e).over(inside)))
    return out.drop("_b", "_m", "_o", *[f"_o_{k}" for k in sums])


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose row count was checked."""
    return F.broadcast(df) if rows <= limit else df
