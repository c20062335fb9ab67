"""Matrix/vector text columns -> rows (the reference's text input format).

The format: rows separated by ``;``, cells by ``,``; cells and rows are
trimmed and empty ones dropped *before* numbering.  Each text value is parsed
where it lives (a per-row generator, no shuffle), so a table of many text
matrices parses in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nonempty_parts(text: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(text, sep), lambda s: F.trim(s)),
                    lambda s: s != F.lit(""))


def _cells(df: DataFrame, text: str, id: str) -> DataFrame:
    rows = df.select(F.col(id), F.posexplode(_nonempty_parts(F.col(text), ";"))
                     .alias("row", "row_text"))
    return rows.select(id, F.col("row").cast("bigint").alias("row"),
                       F.posexplode(_nonempty_parts(F.col("row_text"), ","))
                       .alias("pos", "cell")).withColumn("pos", F.col("pos").cast("bigint"))


def rows_from_text(df: DataFrame, text: str, id: str = "id") -> DataFrame:
    """(id, row, pos, value double) -- a non-number raises (ANSI cast)."""
    return _cells(df, text, id).select(id, "row", "pos",
                                       F.col("cell").cast("double").alias("value"))


def rows_from_text_nulls(df: DataFrame, text: str, id: str = "id") -> DataFrame:
    """As ``rows_from_text`` but ``nan`` in any case becomes NULL."""
    c = F.col("cell")
    return _cells(df, text, id).select(
        id, "row", "pos",
        F.when(F.lower(c) == "nan", F.lit(None).cast("double"))
         .otherwise(c.cast("double")).alias("value"))


def string_rows_from_text(df: DataFrame, text: str, id: str = "id") -> DataFrame:
    """(id, row, pos, value string) for categorical matrices."""
    return _cells(df, text, id).withColumnRenamed("cell", "value")


def values_from_text(df: DataFrame, text: str, id: str = "id") -> DataFrame:
    """Vector text ``"1,2,3"`` -> (id, pos, value double)."""
    return df.select(F.col(id), F.posexplode(_nonempty_parts(F.col(text), ","))
                     .alias("pos", "cell")).select(
        id, F.col("pos").cast("bigint").alias("pos"),
        F.col("cell").cast("double").alias("value"))


def label_to_int(c: str | Column) -> Column:
    """Class label truncation towards zero (0.9 -> 0, -1.7 -> -1)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double").cast("int")
