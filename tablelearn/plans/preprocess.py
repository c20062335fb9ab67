"""Registered queries: scaling (P1-P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scale as sc
from ..sources import tables as tb
from .registry import query, rounded

CUST_FEATURES = ["c_acctbal", "c_nationkey"]


def _scaled(method):
    def run(spark, sf):
        df = tb.f_cust(spark, sf)
        return rounded(sc.scale(df, CUST_FEATURES, method)
                       .select("c_custkey", *CUST_FEATURES))
    return run


def _sql(center0, scale0, center1, scale1, stats):
    return f"""
WITH s AS (SELECT {stats} FROM customer)
SELECT c_custkey,
  round((c_acctbal - {center0}) / {scale0}, 6) AS c_acctbal,
  round((CAST(c_nationkey AS DOUBLE) - {center1}) / {scale1}, 6) AS c_nationkey
FROM customer, s"""


def _nz(x):
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"


ORACLE_SCALE_STANDARD = _sql(
    "m0", _nz("s0"), "m1", _nz("s1"),
    "avg(c_acctbal) m0, stddev_pop(c_acctbal) s0, "
    "avg(c_nationkey) m1, stddev_pop(c_nationkey) s1")
query("scale_standard", ORACLE_SCALE_STANDARD)(_scaled("standard"))
query("scale_minmax", _sql(
    "lo0", _nz("(hi0 - lo0)"), "lo1", _nz("(hi1 - lo1)"),
    "min(c_acctbal) lo0, max(c_acctbal) hi0, "
    "CAST(min(c_nationkey) AS DOUBLE) lo1, CAST(max(c_nationkey) AS DOUBLE) hi1"))(
    _scaled("minmax"))
query("scale_maxabs", _sql(
    "0", _nz("a0"), "0", _nz("a1"),
    "max(abs(c_acctbal)) a0, CAST(max(abs(c_nationkey)) AS DOUBLE) a1"))(_scaled("maxabs"))
query("scale_robust", _sql(
    "q0[2]", _nz("(q0[3] - q0[1])"), "q1[2]", _nz("(q1[3] - q1[1])"),
    "quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) q0, "
    "quantile_cont(CAST(c_nationkey AS DOUBLE), [0.25, 0.5, 0.75]) q1"))(_scaled("robust"))


@query("scaler_params", """
WITH s AS (
  SELECT avg(c_acctbal) m0, stddev_pop(c_acctbal) s0,
         avg(c_nationkey) m1, stddev_pop(c_nationkey) s1 FROM customer)
SELECT 0 AS pos, 'c_acctbal' AS feature, round(m0, 6) AS center,
       round(CASE WHEN s0 = 0 THEN 1 ELSE s0 END, 6) AS scale FROM s
UNION ALL
SELECT 1, 'c_nationkey', round(m1, 6), round(CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) FROM s
""")
def scaler_params(spark, sf):
    model = sc.fit(tb.f_cust(spark, sf), CUST_FEATURES, "standard")
    return rounded(model.params(spark).select("pos", "feature", "center", "scale"))


# ---- encoding (P6-P8) -------------------------------------------------------
from ..operators import encode as enc  # noqa: E402
from ..operators import impute as imp  # noqa: E402
from ..operators import select as sel  # noqa: E402


@query("encode_label_map", """
SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT p_brand AS value FROM part)""")
def encode_label_map(spark, sf):
    return enc.label_map(tb.f_part(spark, sf), "p_brand")


@query("encode_label", """
WITH m AS (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code
           FROM (SELECT DISTINCT p_brand AS value FROM part))
SELECT p_partkey, p_brand AS value, code FROM part JOIN m ON p_brand = value""")
def encode_label(spark, sf):
    return enc.encode_label(tb.f_part(spark, sf), "p_brand", "p_partkey").encoded


_ORD_MAP = """
SELECT pos, "column", value,
       CAST(dense_rank() OVER (PARTITION BY pos ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT 0 AS pos, 'p_brand' AS "column", p_brand AS value FROM part
      UNION ALL SELECT DISTINCT 1, 'p_type', p_type FROM part)"""


@query("encode_ordinal_map", _ORD_MAP)
def encode_ordinal_map(spark, sf):
    return enc.ordinal_maps(tb.f_part(spark, sf), ["p_brand", "p_type"])


@query("encode_ordinal", f"""
WITH m AS ({_ORD_MAP})
SELECT p_partkey, CAST(a.code AS DOUBLE) AS p_brand, CAST(b.code AS DOUBLE) AS p_type
FROM part JOIN m a ON a.pos = 0 AND a.value = p_brand
          JOIN m b ON b.pos = 1 AND b.value = p_type""")
def encode_ordinal(spark, sf):
    return enc.encode_ordinal(tb.f_part(spark, sf), ["p_brand", "p_type"], "p_partkey")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("encode_onehot", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN p_type = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"p_type_{v}\"" for v in _TYPES)
    + " FROM part")
def encode_onehot(spark, sf):
    return enc.encode_onehot(tb.f_part(spark, sf), ["p_type"], "p_partkey")


# ---- imputation (P9-P15) -----------------------------------------------------
NULL_FEATURES = ["p_size", "p_retailprice"]
_F_NULL = """(SELECT p_partkey,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice
  FROM part)"""


def _impute_sql(f0, f1, src=""):
    return f"""
WITH f AS {_F_NULL}, s AS (SELECT {f0} AS a0, {f1} AS a1 FROM {src or 'f'})
SELECT p_partkey, round(coalesce(p_size, a0), 6) AS p_size,
       round(coalesce(p_retailprice, a1), 6) AS p_retailprice FROM f, s"""


def _imputed(strategy):
    def run(spark, sf):
        df = tb.f_null(spark, sf)
        return rounded(imp.impute(df, NULL_FEATURES, strategy))
    return run


query("impute_mean", _impute_sql("avg(p_size)", "avg(p_retailprice)"))(_imputed("mean"))
query("impute_median", _impute_sql("median(p_size)", "median(p_retailprice)"))(
    _imputed("median"))
query("impute_constant", _impute_sql("0.0::DOUBLE", "0.0::DOUBLE", "(SELECT 1)"))(
    _imputed("constant"))

_MODE = """(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM f WHERE {c} IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1))"""
query("impute_most_frequent", f"""
WITH f AS {_F_NULL}
SELECT p_partkey, round(coalesce(p_size, {_MODE.format(c='p_size')}), 6) AS p_size,
       round(coalesce(p_retailprice, {_MODE.format(c='p_retailprice')}), 6) AS p_retailprice
FROM f""")(_imputed("most_frequent"))


@query("missing_stats", f"""
WITH f AS {_F_NULL}
SELECT 0 AS pos, 'p_size' AS feature, CAST(count(*) - count(p_size) AS BIGINT) AS missing,
       CAST(count(*) AS BIGINT) AS total,
       round(CAST(count(*) - count(p_size) AS DOUBLE) * 100 / count(*), 6) AS percent,
       count(p_size) = 0 AS all_missing, round(avg(p_size), 6) AS fill FROM f
UNION ALL
SELECT 1, 'p_retailprice', CAST(count(*) - count(p_retailprice) AS BIGINT),
       CAST(count(*) AS BIGINT),
       round(CAST(count(*) - count(p_retailprice) AS DOUBLE) * 100 / count(*), 6),
       count(p_retailprice) = 0, round(avg(p_retailprice), 6) FROM f""")
def missing_stats(spark, sf):
    df = tb.f_null(spark, sf)
    model = imp.fit(df, NULL_FEATURES, "mean")
    return rounded(imp.missing_stats(df, NULL_FEATURES, model))


@query("impute_all_null_column", """
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, CAST(NULL AS DOUBLE) AS empty
FROM part""")
def impute_all_null_column(spark, sf):
    """A column with no present value stays NULL (the others are filled)."""
    df = tb.read(spark, sf, "part").select(
        "p_partkey", "p_retailprice", F.lit(None).cast("double").alias("empty"))
    return rounded(imp.impute(df, ["p_retailprice", "empty"], "mean"))


# ---- feature scores (P16, P17, P20) -----------------------------------------
ORDER_FEATURES = ["sum_qty", "avg_disc", "avg_tax", "n_items", "o_totalprice"]
_F_ORDER = """(SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice / 1000.0 AS price_k, sum_qty, avg_disc, avg_tax, n_items
  FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc,
                           avg(l_tax) AS avg_tax, CAST(count(*) AS DOUBLE) AS n_items
                    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def _anova_sql():
    parts = []
    for i, c in enumerate(ORDER_FEATURES[:4]):
        parts.append(f"""SELECT {i} AS pos, '{c}' AS feature, o_orderstatus AS g,
            count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM f GROUP BY o_orderstatus""")
    return f"""
WITH f AS {_F_ORDER}, pc AS ({' UNION ALL '.join(parts)}),
g AS (SELECT *, sum(n * m) OVER (PARTITION BY pos) / sum(n) OVER (PARTITION BY pos) AS grand,
             sum(n) OVER (PARTITION BY pos) AS nn, count(*) OVER (PARTITION BY pos) AS k FROM pc),
s AS (SELECT pos, feature, sum(n * (m - grand) * (m - grand)) AS ssb, sum(n * v) AS ssw,
             any_value(nn) AS nn, any_value(k) AS k FROM g GROUP BY pos, feature)"""


@query("select_f_classif", _anova_sql() + """
SELECT CAST(pos AS INTEGER) AS pos, feature,
       round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS score FROM s""")
def select_f_classif(spark, sf):
    return rounded(sel.f_classif(tb.f_order(spark, sf), ORDER_FEATURES[:4], "o_orderstatus"))


@query("select_f_regression", "WITH f AS " + _F_ORDER + " " + " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{c}' AS feature,
    round(corr({c}, o_totalprice) * corr({c}, o_totalprice)
          / (1 - corr({c}, o_totalprice) * corr({c}, o_totalprice)) * (count(*) - 2), 6) AS score
    FROM f""" for i, c in enumerate(ORDER_FEATURES[:4])))
def select_f_regression(spark, sf):
    return rounded(sel.f_regression(tb.f_order(spark, sf), ORDER_FEATURES[:4], "o_totalprice"))


@query("select_k_best", _anova_sql() + """,
sc AS (SELECT pos, feature, round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS score FROM s)
SELECT CAST(pos AS INTEGER) AS pos, feature, score,
       CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, pos) AS BIGINT) AS rank,
       row_number() OVER (ORDER BY score DESC NULLS LAST, pos) <= 2 AS selected FROM sc""")
def select_k_best(spark, sf):
    ranked, _ = sel.select_k_best(tb.f_order(spark, sf), ORDER_FEATURES[:4],
                                  "o_orderstatus", k=2, id="o_orderkey")
    return rounded(ranked)


# ---- mutual information (P18, P19) and RFE (P21): checked against brute force in tests
@query("select_mi_classif")
def select_mi_classif(spark, sf):
    from ..operators import mutual_info as mi
    return rounded(mi.mi_classif(tb.f_order(spark, sf), ORDER_FEATURES[:4], "o_orderstatus",
                                 3, "o_orderkey"))


@query("select_mi_regression")
def select_mi_regression(spark, sf):
    from ..operators import mutual_info as mi
    return rounded(mi.mi_regression(tb.f_learn(spark, sf), ["x0"], "x1", 3, "vec_id"))


@query("select_rfe")
def select_rfe(spark, sf):
    df = tb.f_event(spark, sf)
    return sel.rfe(df, ["value", "hour", "k"], "purchase", k=1)


# ---- streaming scoring: the fitted scaler applied to a file stream -----------------
@query("stream_scale_standard", ORACLE_SCALE_STANDARD)
def stream_scale_standard(spark, sf):
    from ..session import table_path
    from ..streaming import score
    model = sc.fit(tb.f_cust(spark, sf), CUST_FEATURES, "standard")
    stream = score.parquet_stream(spark, table_path(sf, "customer"))
    out = score.run_available(
        spark, stream,
        lambda s: model.transform(s.select("c_custkey", "c_acctbal",
                                           F.col("c_nationkey").cast("double")
                                           .alias("c_nationkey")),
                                  keep=["c_custkey", *CUST_FEATURES]))
    return rounded(out)
