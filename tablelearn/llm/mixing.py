"""Mixing sources to target weights.

Words are summed per source, each source gets a target, and its repetition
rate is target over size.  A document is taken ``floor(rate)`` times, and once
more with probability ``rate - floor(rate)``, drawn by a hash of the seed and
its id.  Reruns, and recomputed partitions, take the same copies.

Targets: the sources share ``share`` times all words by weight; a source stops
at ``cap`` times its size and the excess is shared by weight among the others
until none is above.  That is water-filling: target = min(weight * level, cap
* size).  Each round is one aggregate over the table of sources, and only its
three sums come to the driver.

Sources are ranked by code point, null last, for their weights, by the
library's distributed ranking.  The table of sources is broadcast only if its
measured size is under ``BROADCAST_BYTES``; beyond that Spark joins by
shuffle and splits a hot source's rows.

Defined cases: null text has size 0; null is a source; a source without words
has target 0 and takes nothing; if all sources are at the cap, the mix is
smaller than its share; repeated rows (same id) share their draw; a null id
draws as the word null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from .common import Scratch, need

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """``target`` added to a written table (source, source_size), one row per source."""
    ranked = global_rank(sizes, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "place")
    weight = F.array(*[F.lit(float(w)) for w in weights])[
        (F.col("place") % len(weights)).cast("int")]
    table = ranked.withColumn("weight", weight)
    limit = cap * F.col("source_size")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:                         # the set of capped sources grows, or the loop ends
        full = F.lit(False) if level is None else F.col("weight") * level > limit
        row = table.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
                        F.count(F.when(full, 1))).first()
        if row[2] == capped:
            break
        capped = row[2]
        if not row[1]:
            level = None
            break
        level = (share * total - row[0]) / row[1]
    target = limit if level is None else F.least(F.col("weight") * F.lit(level), limit)
    return table.select("source", "source_size", target.alias("target"))


def with_copies(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
                seed: str = SEED) -> DataFrame:
    """The rows of ``df`` as ``_0``, ``_1``, ... with size, source_size, target, copies."""
    need(df, id, text, source)
    at = {c: f"_{df.columns.index(c)}" for c in (id, text, source)}
    rows = (df.toDF(*[f"_{i}" for i in range(len(df.columns))])
            .withColumn("size", size_of(F.col(at[text]).cast("string")))
            .withColumn("source", F.col(at[source]).cast("string")))
    scratch = Scratch(df.sparkSession)
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = targets(sizes, weights, share, cap)
    n = sizes.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    if n <= BROADCAST_BYTES:
        goal = F.broadcast(goal)
    goal = goal.withColumnRenamed("source", "_source")
    joined = rows.join(goal, rows["source"].eqNullSafe(goal["_source"])).drop("_source", "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = unit(F.col(at[id]), seed)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    plan = with_copies(df, **options)
    rows = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[f"_{i}" for i in range(len(df.columns))]).toDF(*df.columns)
