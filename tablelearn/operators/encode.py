"""Categorical encoding: label, one-hot, ordinal.

Codes follow lexicographic order of the distinct values.  The code table is
built from the *distinct* values only (a partial-aggregated ``distinct``),
ranked with the distributed ``global_rank`` and joined back; the join is a
broadcast only when the counted number of categories is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import check_columns
from ..functions.rank import global_rank, maybe_broadcast
from ..session import cut_lineage



def label_map(df: DataFrame, col: str) -> DataFrame:
    """(value, code) with code = 0..k-1 in lexicographic order of value."""
    check_columns(df, [col])
    d = df.select(F.col(col).cast("string").alias("value")).where(
        F.col("value").isNotNull()).distinct()
    return global_rank(d, [F.col("value")], "code").select(
        "value", F.col("code").cast("bigint").alias("code"))


@dataclass
class LabelEncoding:
    mapping: DataFrame   # value, code
    encoded: DataFrame   # id, value, code
    n_classes: int


def encode_label(df: DataFrame, col: str, id: str = "id") -> LabelEncoding:
    m = cut_lineage(label_map(df, col))
    k = m.count()
    enc = df.select(F.col(id), F.col(col).cast("string").alias("value")).join(
        maybe_broadcast(m, k), "value", "left")
    return LabelEncoding(m, enc.select(id, "value", "code"), k)


def ordinal_maps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pos, column, value, code) for every column, codes per column."""
    check_columns(df, cols)
    longf = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                 F.col(c).cast("string").alias("value"))
        for i, c in enumerate(cols)]))).where(F.col("value").isNotNull()).distinct()
    r = global_rank(longf, [F.col("pos"), F.col("value")], "_g")
    first = r.groupBy("pos").agg(F.min("_g").alias("_g0"))
    return r.join(F.broadcast(first), "pos").select(
        F.col("pos").cast("int").alias("pos"), "column", "value",
        (F.col("_g") - F.col("_g0")).cast("bigint").alias("code"))


def encode_ordinal(df: DataFrame, cols: Sequence[str], id: str = "id",
                   maps: DataFrame | None = None) -> DataFrame:
    """Each column replaced by its double code; an unseen value raises.

    One join per column against that column's code table (broadcast when the
    counted table is small), so rows never regroup by id.
    """
    maps = cut_lineage(maps if maps is not None else ordinal_maps(df, cols))
    k = maps.count()
    out = df.select(F.col(id), *[F.col(c).cast("string").alias(f"_v{i}")
                                 for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        mi = maps.where(F.col("pos") == i).select(
            F.col("value").alias(f"_v{i}"), F.col("code").cast("double").alias(c))
        out = out.join(maybe_broadcast(mi, k), f"_v{i}", "left")
    bad = F.lit(False)
    for i, c in enumerate(cols):
        bad = bad | (F.col(c).isNull() & F.col(f"_v{i}").isNotNull())
    if out.where(bad).limit(1).count():
        raise ValueError("found unknown categories during transform")
    return out.select(id, *cols)


def onehot_columns(df: DataFrame, cols: Sequence[str],
                   max_categories: int | None = None) -> list[tuple[str, str]]:
    """(column, category) pairs in output order; the schema needs them.

    ``max_categories`` is for callers that want an error beyond a width of their own.
    """
    maps = ordinal_maps(df, cols)
    n = maps.count()
    if max_categories is not None and n > max_categories:
        raise ValueError(f"{n} categories exceed max_categories={max_categories}")
    rows = maps.orderBy("pos", "code").collect()
    return [(r["column"], r["value"]) for r in rows]


def encode_onehot(df: DataFrame, cols: Sequence[str], id: str = "id",
                  categories: list[tuple[str, str]] | None = None) -> DataFrame:
    """One 0/1 double column ``{column}_{category}`` per category; unseen -> zeros."""
    cats = categories if categories is not None else onehot_columns(df, cols)
    return df.select(F.col(id), *[
        F.when(F.col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c, v in cats])
