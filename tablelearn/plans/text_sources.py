"""Registered queries: text-matrix sources (S1-S4, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as tb
from ..sources import text as tx
from .registry import query, rounded

# The text column is derived from ``part`` identically in both engines.
_NUM_TEXT = ("concat(CAST(p_size AS STRING), ', ', CAST(p_partkey % 97 AS STRING), "
             "' ;; ', CAST(p_partkey % 13 AS STRING), ',,', CAST(p_size * 2 AS STRING), ' ; ')")
_NAN_TEXT = ("concat(CASE WHEN p_partkey % 5 = 0 THEN 'NaN' ELSE CAST(p_size AS STRING) END, "
             "',', CAST(p_partkey % 97 AS STRING), ';', "
             "CASE WHEN p_partkey % 3 = 0 THEN ' nan' ELSE '7' END, ',', CAST(p_size AS STRING))")
_VEC_TEXT = ("concat(CAST(p_size AS STRING), ',', CAST(p_partkey % 97 AS STRING), ', ,', "
             "CAST(p_partkey % 13 AS STRING))")
_STR_TEXT = "concat(p_brand, ',', p_type, ';', p_type, ', ')"


def _text(spark, sf, expr):
    return tb.read(spark, sf, "part").select("p_partkey", F.expr(expr).alias("text"))


def _duck(expr):
    return expr.replace("AS STRING", "AS VARCHAR")


def _sql_cells(expr, value):
    return f"""
WITH t AS (SELECT p_partkey, {_duck(expr)} AS text FROM part),
r AS (SELECT p_partkey, l, generate_subscripts(l, 1) AS i
      FROM (SELECT p_partkey, list_filter(list_transform(string_split(text, ';'),
                   lambda x: trim(x)), lambda x: x <> '') AS l FROM t)),
c AS (SELECT p_partkey, i, list_filter(list_transform(string_split(l[i], ','),
             lambda x: trim(x)), lambda x: x <> '') AS cl FROM r),
e AS (SELECT p_partkey, i, cl, generate_subscripts(cl, 1) AS j FROM c)
SELECT p_partkey, CAST(i - 1 AS BIGINT) AS row, CAST(j - 1 AS BIGINT) AS pos,
       {value} AS value FROM e"""


@query("rows_from_text", _sql_cells(_NUM_TEXT, "CAST(cl[j] AS DOUBLE)"))
def rows_from_text(spark, sf):
    return tx.rows_from_text(_text(spark, sf, _NUM_TEXT), "text", "p_partkey")


@query("rows_from_text_nulls", _sql_cells(
    _NAN_TEXT, "CASE WHEN lower(cl[j]) = 'nan' THEN NULL ELSE CAST(cl[j] AS DOUBLE) END"))
def rows_from_text_nulls(spark, sf):
    return tx.rows_from_text_nulls(_text(spark, sf, _NAN_TEXT), "text", "p_partkey")


@query("string_rows_from_text", _sql_cells(_STR_TEXT, "cl[j]"))
def string_rows_from_text(spark, sf):
    return tx.string_rows_from_text(_text(spark, sf, _STR_TEXT), "text", "p_partkey")


@query("values_from_text", f"""
WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split({_duck(_VEC_TEXT)}, ','),
             lambda x: trim(x)), lambda x: x <> '') AS l FROM part),
e AS (SELECT p_partkey, l, generate_subscripts(l, 1) AS j FROM t)
SELECT p_partkey, CAST(j - 1 AS BIGINT) AS pos, CAST(l[j] AS DOUBLE) AS value FROM e""")
def values_from_text(spark, sf):
    return tx.values_from_text(_text(spark, sf, _VEC_TEXT), "text", "p_partkey")


@query("label_to_int", """
SELECT event_id, CAST(trunc(value / 7 - 5) AS INTEGER) AS label FROM events""")
def label_to_int(spark, sf):
    ev = tb.read(spark, sf, "events")
    return ev.select("event_id", tx.label_to_int(F.col("value") / 7 - 5).alias("label"))


@query("table_input", """
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       c_mktsegment FROM customer""")
def table_input(spark, sf):
    return rounded(tb.f_cust(spark, sf))
