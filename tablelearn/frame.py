"""Feature frames: validation, NaN handling, long form, array/columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def check_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; have {df.columns}")


def check_numeric(df: DataFrame, features: Sequence[str]) -> None:
    check_columns(df, features)
    if not features:
        raise ValueError("at least one feature column is required")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    bad = [c for c in features if not isinstance(types[c], NUMERIC)]
    if bad:
        raise ValueError(f"feature columns must be numeric: {bad}")


def as_double(c: str | Column) -> Column:
    """Double value with NaN normalised to NULL (the only safe missing code)."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def long_form(df: DataFrame, features: Sequence[str], id: str = "id",
              extra: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Unpivot feature columns to (id, extra..., pos, feature, value)."""
    stack = F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                 as_double(c).alias(value))
        for i, c in enumerate(features)]))
    return df.select(F.col(id), *[F.col(e) for e in extra], stack)
