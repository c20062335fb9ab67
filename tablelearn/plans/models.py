"""Registered queries: regression (R1-R8), PCA (K10), logistic (C1-C5, E21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as lin
from ..operators import logistic as lg
from ..operators import metrics as mt
from ..operators import pca
from ..sources import tables as tb
from . import sqlparts as S
from .preprocess import _F_ORDER
from .registry import query, rounded

REG_X = ["sum_qty", "avg_disc"]
REG_Y = "price_k"

_COV2 = f"""f AS {_F_ORDER},
s AS (SELECT covar_pop(sum_qty, sum_qty) saa, covar_pop(sum_qty, avg_disc) sab,
             covar_pop(avg_disc, avg_disc) sbb, covar_pop(sum_qty, price_k) say,
             covar_pop(avg_disc, price_k) sby, avg(sum_qty) ma, avg(avg_disc) mb,
             avg(price_k) my, count(*) n FROM f)"""


def _coef_rows(w0, wa, wb, nonzero=True):
    nz = (lambda w: f"{w} <> 0") if nonzero else (lambda w: "true")
    return f"""
SELECT -1 AS pos, '(intercept)' AS feature, round({w0}, 6) AS coef, true AS nonzero FROM c
UNION ALL SELECT 0, 'sum_qty', round({wa}, 6), {nz(wa)} FROM c
UNION ALL SELECT 1, 'avg_disc', round({wb}, 6), {nz(wb)} FROM c"""


_LINEAR_C = f"""WITH {_COV2},
c AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM (
      SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
                (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM s))"""


@query("linear_regression", _LINEAR_C + _coef_rows("w0", "wa", "wb"))
def linear_regression(spark, sf):
    m = lin.linear_regression(tb.f_order(spark, sf), REG_X, REG_Y)
    return rounded(m.coefficients(spark))


@query("ridge_regression", f"""WITH {_COV2},
c AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM (
      SELECT *, (n * say * (n * sbb + 10.0) - n * sby * n * sab)
                / ((n * saa + 10.0) * (n * sbb + 10.0) - n * sab * n * sab) AS wa,
                ((n * saa + 10.0) * n * sby - n * sab * n * say)
                / ((n * saa + 10.0) * (n * sbb + 10.0) - n * sab * n * sab) AS wb FROM s))"""
       + _coef_rows("w0", "wa", "wb"))
def ridge_regression(spark, sf):
    m = lin.ridge_regression(tb.f_order(spark, sf), REG_X, REG_Y, alpha=10.0)
    return rounded(m.coefficients(spark))


_LASSO_C = f"""WITH {_COV2},
c AS (SELECT *, my - w * ma AS w0 FROM (
      SELECT *, sign(say) * greatest(abs(say) - 1.0, 0) / saa AS w FROM s))"""


@query("lasso_regression", _LASSO_C + """
SELECT -1 AS pos, '(intercept)' AS feature, round(w0, 6) AS coef, true AS nonzero FROM c
UNION ALL SELECT 0, 'sum_qty', round(w, 6), w <> 0 FROM c""")
def lasso_regression(spark, sf):
    m = lin.lasso_regression(tb.f_order(spark, sf), ["sum_qty"], REG_Y, alpha=1.0)
    return rounded(m.coefficients(spark))


@query("lasso_sparsity", _LASSO_C + """
SELECT 1 AS n_features, CAST(CASE WHEN w <> 0 THEN 1 ELSE 0 END AS INTEGER) AS nonzero,
       round(1.0 - CASE WHEN w <> 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS sparsity FROM c""")
def lasso_sparsity(spark, sf):
    m = lin.lasso_regression(tb.f_order(spark, sf), ["sum_qty"], REG_Y, alpha=1.0)
    return rounded(lin.sparsity(m, spark))


@query("polynomial_features", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, round(p_retailprice, 6) AS p_retailprice,
       CAST(p_size * p_size AS DOUBLE) AS "p_size^2",
       round(p_size * p_retailprice, 6) AS "p_size p_retailprice",
       round(p_retailprice * p_retailprice, 6) AS "p_retailprice^2" FROM part""")
def polynomial_features(spark, sf):
    out, _ = lin.polynomial_features(tb.f_part(spark, sf), ["p_size", "p_retailprice"], 2,
                                     id="p_partkey")
    return rounded(out)


_POLY = """WITH f AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a,
                         CAST(p_size AS DOUBLE) * p_size AS b, p_retailprice AS y FROM part),
s AS (SELECT covar_pop(a, a) saa, covar_pop(a, b) sab, covar_pop(b, b) sbb,
             covar_pop(a, y) say, covar_pop(b, y) sby, avg(a) ma, avg(b) mb, avg(y) my FROM f),
c AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM (
      SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
                (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM s))"""


def _poly_model(spark, sf):
    return lin.polynomial_regression(tb.f_part(spark, sf), ["p_size"], "p_retailprice", 2,
                                     id="p_partkey")


@query("polynomial_regression", _POLY + """
SELECT -1 AS pos, '(intercept)' AS feature, round(w0, 6) AS coef, true AS nonzero FROM c
UNION ALL SELECT 0, 'p_size', round(wa, 6), wa <> 0 FROM c
UNION ALL SELECT 1, 'p_size^2', round(wb, 6), wb <> 0 FROM c""")
def polynomial_regression(spark, sf):
    return rounded(_poly_model(spark, sf).coefficients(spark))


@query("regression_metrics", _LINEAR_C + """,
p AS (SELECT price_k AS y, w0 + wa * sum_qty + wb * avg_disc AS yhat FROM f, c),
a AS (SELECT avg((y - yhat) * (y - yhat)) mse, avg(abs(y - yhat)) mae,
             sum((y - yhat) * (y - yhat)) sse, var_pop(y) * count(*) sst, count(*) n FROM p)
SELECT round(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
       round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
       CAST(n AS BIGINT) AS n FROM a""")
def regression_metrics(spark, sf):
    df = tb.f_order(spark, sf)
    m = lin.linear_regression(df, REG_X, REG_Y)
    return rounded(mt.regression_metrics(m.predict(df, "o_orderkey", keep=[REG_Y]), REG_Y))


@query("regression_predict", _LINEAR_C + """
SELECT o_orderkey, round(w0 + wa * sum_qty + wb * avg_disc, 6) AS prediction FROM f, c""")
def regression_predict(spark, sf):
    df = tb.f_order(spark, sf)
    return rounded(lin.linear_regression(df, REG_X, REG_Y).predict(df, "o_orderkey"))


# ---- PCA (K10) ------------------------------------------------------------------------
_PCA = f"""WITH learn AS {S.LEARN},
s AS (SELECT covar_samp(x0, x0) a, covar_samp(x0, x1) b, covar_samp(x1, x1) c,
             avg(x0) m0, avg(x1) m1 FROM learn),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
                (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM s),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1x,
                (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1y,
                b / sqrt(b * b + (l2 - a) * (l2 - a)) AS u2x,
                (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS u2y FROM e),
v AS (SELECT *, CASE WHEN abs(u1x) >= abs(u1y) THEN sign(u1x) ELSE sign(u1y) END AS s1,
                CASE WHEN abs(u2x) >= abs(u2y) THEN sign(u2x) ELSE sign(u2y) END AS s2 FROM u)"""


def _pca_model(spark, sf):
    return pca.fit(tb.f_learn(spark, sf), ["x0", "x1"], 2)


@query("pca_variance", _PCA + """
SELECT 1 AS component, round(l1, 6) AS eigenvalue, round(l1 / (l1 + l2), 6) AS ratio,
       round(l1 / (l1 + l2), 6) AS cumulative FROM v
UNION ALL SELECT 2, round(l2, 6), round(l2 / (l1 + l2), 6), 1.0::DOUBLE FROM v""")
def pca_variance(spark, sf):
    return rounded(_pca_model(spark, sf).variance(spark))


@query("pca_components", _PCA + """
SELECT 1 AS component, 0 AS pos, 'x0' AS feature, round(s1 * u1x, 6) AS loading FROM v
UNION ALL SELECT 1, 1, 'x1', round(s1 * u1y, 6) FROM v
UNION ALL SELECT 2, 0, 'x0', round(s2 * u2x, 6) FROM v
UNION ALL SELECT 2, 1, 'x1', round(s2 * u2y, 6) FROM v""")
def pca_components(spark, sf):
    return rounded(_pca_model(spark, sf).loadings(spark))


@query("pca_scores", _PCA + """
SELECT vec_id, round((x0 - m0) * s1 * u1x + (x1 - m1) * s1 * u1y, 6) AS pc1,
       round((x0 - m0) * s2 * u2x + (x1 - m1) * s2 * u2y, 6) AS pc2 FROM learn, v""")
def pca_scores(spark, sf):
    return rounded(_pca_model(spark, sf).transform(tb.f_learn(spark, sf), "vec_id"))


# ---- logistic (C1-C5, E21) --------------------------------------------------------
def _newton_sql(inv_c: str, l1: str = "0.0") -> str:
    """12 unrolled Newton steps (recursive CTE) for y ~ x0 + x1 on F_learn.

    ``l1`` weighs the sum of the coefficients, which is their L1 norm where
    both are positive; c has no row elsewhere.
    """
    return f"""WITH RECURSIVE learn AS {S.LEARN},
it(k, b0, b1, b2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, b0 - (A11 * g0 + A12 * g1 + A13 * g2) / det,
         b1 - (A12 * g0 + A22 * g1 + A23 * g2) / det,
         b2 - (A13 * g0 + A23 * g1 + A33 * g2) / det
  FROM (SELECT *, a * A11 + b * A12 + c * A13 AS det FROM (
    SELECT *, d * f - e * e AS A11, c * e - b * f AS A12, b * e - c * d AS A13,
              a * f - c * c AS A22, b * c - a * e AS A23, a * d - b * b AS A33 FROM (
      SELECT k, b0, b1, b2,
             sum(s - y) AS g0, sum((s - y) * x0) + b1 * {inv_c} + {l1} AS g1,
             sum((s - y) * x1) + b2 * {inv_c} + {l1} AS g2,
             sum(w) AS a, sum(w * x0) AS b, sum(w * x1) AS c,
             sum(w * x0 * x0) + {inv_c} AS d, sum(w * x0 * x1) AS e,
             sum(w * x1 * x1) + {inv_c} AS f
      FROM (SELECT it.*, learn.x0, learn.x1, learn.y,
                   1 / (1 + exp(-(b0 + b1 * x0 + b2 * x1))) AS s,
                   1 / (1 + exp(-(b0 + b1 * x0 + b2 * x1)))
                   * (1 - 1 / (1 + exp(-(b0 + b1 * x0 + b2 * x1)))) AS w
            FROM it, learn WHERE it.k < 12)
      GROUP BY k, b0, b1, b2)))),
c AS (SELECT b0, b1, b2 FROM it WHERE k = 12 AND ({l1} = 0 OR b1 > 0 AND b2 > 0))"""


_LOGIT_ROWS = """
SELECT 0 AS row, -1 AS pos, '(intercept)' AS feature, round(b0, 5) AS coef FROM c
UNION ALL SELECT 0, 0, 'x0', round(b1, 5) FROM c
UNION ALL SELECT 0, 1, 'x1', round(b2, 5) FROM c"""


def _logit(penalty, C=1.0, digits=5):
    def run(spark, sf):
        m = lg.fit(tb.f_learn(spark, sf), ["x0", "x1"], "y", C=C, penalty=penalty)
        return rounded(m.coefficients(spark), digits)
    return run


query("logistic_l2", _newton_sql("1.0") + _LOGIT_ROWS)(_logit("l2"))
query("logistic_none", _newton_sql("0.0") + _LOGIT_ROWS)(_logit("none"))
query("logistic_l1", _newton_sql("0.0", "1.0") + _LOGIT_ROWS)(_logit("l1"))
query("logistic_elasticnet", _newton_sql("0.5", "0.5") + _LOGIT_ROWS)(_logit("elasticnet"))


@query("logistic_multiclass")
def logistic_multiclass(spark, sf):
    df = tb.f_event(spark, sf)
    m = lg.fit(df, ["value", "hour", "k"], "event_type", C=1.0, penalty="l2", max_iter=200)
    return rounded(m.coefficients(spark), 4)


@query("logistic_multiclass_balance", f"""WITH ev AS {S.EVENT},
long AS (SELECT event_type, -1 AS pos, '(intercept)' AS feature, 1.0::DOUBLE AS x FROM ev
  UNION ALL SELECT event_type, 0, 'value', CAST(value AS DOUBLE) FROM ev
  UNION ALL SELECT event_type, 1, 'hour', hour FROM ev UNION ALL SELECT event_type, 2, 'k', k FROM ev)
SELECT CAST(event_type AS VARCHAR) AS class, CAST(pos AS INTEGER) AS pos, feature,
       round(sum(x) / (SELECT count(*) FROM ev), 5) AS balance FROM long GROUP BY event_type, pos, feature""")
def logistic_multiclass_balance(spark, sf):
    """The optimality conditions of the softmax model, whose other side SQL has from the table alone."""
    df = tb.f_event(spark, sf)
    m = lg.fit(df, ["value", "hour", "k"], "event_type", C=1.0, penalty="l2")
    return rounded(lg.share_balance(m, df, "event_type"), 5)


@query("feature_importance_logistic", _newton_sql("1.0") + """
SELECT 0 AS pos, 'x0' AS feature, round(abs(b1), 5) AS importance FROM c
UNION ALL SELECT 1, 'x1', round(abs(b2), 5) FROM c""")
def feature_importance_logistic(spark, sf):
    m = lg.fit(tb.f_learn(spark, sf), ["x0", "x1"], "y", C=1.0, penalty="l2")
    rows = [(j, f, float(abs(w))) for j, f in enumerate(m.features) for w in [m.coef[0, j]]]
    return rounded(spark.createDataFrame(rows, "pos int, feature string, importance double"), 5)
