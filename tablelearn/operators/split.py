"""Train/test splits and stratified folds with exact sizes.

Randomness is a hash: rows are ordered by ``md5(seed:id)`` (then id), so a
split repeats for a seed, and does not depend on partitioning.  Positions
come from the distributed ``global_rank`` (range partitioning), never from a
window over the whole table or over one class: a class holding a third of
the rows is still spread over many tasks.  Per-class quotas are computed on
the class-count table (one row per class).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import check_columns
from ..functions.rank import global_rank, maybe_broadcast
from ..session import cut_lineage


def hash_key(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def _n_test(n: int, test_size: float) -> int:
    if isinstance(test_size, float) and 0 < test_size < 1:
        k = math.ceil(test_size * n)
    elif float(test_size).is_integer() and test_size >= 1:
        k = int(test_size)
    else:
        raise ValueError(f"test_size must be in (0, 1) or a count; got {test_size}")
    if k <= 0 or k >= n:
        raise ValueError(f"split of {n} rows with test_size={test_size} leaves an empty set")
    return k


def train_test_split(df: DataFrame, id: str = "id", test_size: float = 0.2,
                     seed: int = 42, shuffle: bool = True,
                     stratify: str | None = None) -> DataFrame:
    """``df`` plus a ``split`` column ('train' / 'test').

    shuffle: the first ``ceil(test_size*n)`` rows in md5(seed:id) order are
    the test set; ``shuffle=False``: the last rows in id order.
    stratify: per-class quotas (largest remainder; ties -> smaller class),
    train quotas first and test quotas from what is left, then the first
    rows of each class in hash order go to the test set.
    """
    check_columns(df, [id] + ([stratify] if stratify else []))
    n = df.count()
    n_test = _n_test(n, test_size)
    if stratify:
        return _stratified(df, id, n, n_test, seed, stratify)
    if shuffle:
        r = global_rank(df, [hash_key(id, seed), F.col(id)], "_r")
        split = F.when(F.col("_r") < n_test, "test").otherwise("train")
    else:
        r = global_rank(df, [F.col(id)], "_r")
        split = F.when(F.col("_r") >= n - n_test, "test").otherwise("train")
    return r.withColumn("split", split).drop("_r")


def _approx_mode(counts: DataFrame, total: int, draws: int, cnt: str, out: str,
                 label: str) -> DataFrame:
    """Largest-remainder allocation of ``draws`` over classes (exact integers)."""
    part = F.col(cnt).cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")
    rem = part % F.lit(total).cast("decimal(19,0)")
    floored = ((part - rem) / F.lit(total).cast("decimal(19,0)")).cast("bigint")
    c = counts.withColumn("_fl", floored).withColumn("_rem", rem)
    need = draws - c.agg(F.sum("_fl")).first()[0]
    w = Window.orderBy(F.col("_rem").desc(), F.col(label))  # one row per class
    return (c.withColumn("_o", F.row_number().over(w))
            .withColumn(out, F.col("_fl") + F.when((F.col("_o") <= need) & (F.col("_rem") > 0), 1)
                        .otherwise(0))
            .drop("_fl", "_rem", "_o"))


def class_quotas(df: DataFrame, label: str, n: int, n_test: int) -> DataFrame:
    """(label, n_class, n_train, n_test) -- one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    counts = cut_lineage(counts)
    q = _approx_mode(counts, n, n - n_test, "n_class", "n_train", label)
    # the test allocation of what is left is exact: draws == rows left
    return q.withColumn("n_test", F.col("n_class") - F.col("n_train"))


def _join_classes(rows: DataFrame, classes: DataFrame, label: str, k: int | None = None) -> DataFrame:
    """Rows with the columns of their class; the null class is a class too."""
    info = classes.withColumnRenamed(label, "_class")
    if k is not None:
        info = maybe_broadcast(info, k)
    return rows.join(info, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def _stratified(df, id, n, n_test, seed, label):
    q = cut_lineage(class_quotas(df, label, n, n_test))
    k = q.count()
    # position inside the class = global position - first position of the class
    r = global_rank(df, [F.col(label), hash_key(id, seed), F.col(id)], "_g")
    start = r.groupBy(label).agg(F.min("_g").alias("_g0"))
    r = _join_classes(r, _join_classes(start, q.select(label, "n_test"), label), label, k)
    split = F.when(F.col("_g") - F.col("_g0") < F.col("n_test"), "test").otherwise("train")
    return r.withColumn("split", split).drop("_g", "_g0", "n_test")


def split_class_distribution(split_df: DataFrame, label: str) -> DataFrame:
    """(label, n_train, n_test, n_total) per class."""
    return split_df.groupBy(label).agg(
        F.count_if(F.col("split") == "train").cast("bigint").alias("n_train"),
        F.count_if(F.col("split") == "test").cast("bigint").alias("n_test"),
        F.count(F.lit(1)).cast("bigint").alias("n_total"))


def split_shapes(split_df: DataFrame, n_features: int) -> DataFrame:
    """(split, rows, features)."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(n_features).cast("int").alias("features"))


def stratified_folds(df: DataFrame, label: str, cv: int = 5, id: str = "id") -> DataFrame:
    """``df`` plus ``fold`` in 0..cv-1: stratified, unshuffled k-fold.

    Classes are laid out by first appearance (smallest id), rows by id, at
    positions p; fold f of class c gets ``#{p in c : p % cv == f}`` rows,
    filled in fold order by id.  Every class needs at least ``cv`` rows.
    """
    check_columns(df, [id, label])
    if cv < 2:
        raise ValueError("cv must be at least 2")
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nk"), F.min(id).alias("_first"))
    cls = cut_lineage(cls)
    k = cls.count()
    small = cls.where(F.col("_nk") < cv).limit(1).collect()
    if small:
        raise ValueError(f"n_splits={cv} is greater than the members of class "
                         f"{small[0][label]!r} ({small[0]['_nk']})")
    w = Window.orderBy("_first")  # one row per class
    cls = cls.withColumn("_ci", F.row_number().over(w)).withColumn(
        "_start", F.sum("_nk").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cls = cls.withColumn("_start", F.coalesce(F.col("_start"), F.lit(0)))
    # cumulative allocation bounds C(f+1) for f = 0..cv-1
    bounds = []
    acc = F.lit(0).cast("bigint")
    for f in range(cv):
        r_f = F.pmod(F.lit(f) - F.col("_start"), F.lit(cv))
        alloc = F.greatest(F.lit(0), F.ceil((F.col("_nk") - r_f) / cv)).cast("bigint")
        acc = acc + alloc
        bounds.append(acc.alias(f"_b{f}"))
    cls = cls.select(label, "_start", *bounds)
    r = global_rank(df, [F.col(label), F.col(id)], "_g")
    first = r.groupBy(label).agg(F.min("_g").alias("_g0"))
    r = _join_classes(r, _join_classes(first, cls, label), label, k)
    j = F.col("_g") - F.col("_g0")
    fold = sum((F.when(j >= F.col(f"_b{f}"), 1).otherwise(0) for f in range(cv - 1)),
               F.lit(0))
    return r.withColumn("fold", fold.cast("int")).drop(
        "_g", "_g0", "_start", *[f"_b{f}" for f in range(cv)])
