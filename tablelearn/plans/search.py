"""Registered queries: SVM (C9-C15), cross-validation, grid search, learning curves
(E6-E9, E23-E26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as se
from ..operators import svm
from ..sources import tables as tb
from . import sqlparts as S
from .registry import query, rounded


def _svm(kernel, probability=False):
    def run(spark, sf):
        df = tb.f_learn(spark, sf)
        m = svm.fit(df, ["x0", "x1"], "y", C=1.0, kernel=kernel, id="vec_id",
                    probability=probability)
        return rounded(m.predict(df, "vec_id", keep=["y"], proba=probability), 4)
    return run


query("svm_linear")(_svm("linear"))
query("svm_rbf")(_svm("rbf"))
query("svm_poly")(_svm("poly"))
query("svm_sigmoid")(_svm("sigmoid"))
query("svm_proba")(_svm("linear", probability=True))


# the same interior-point method with a row of state for each row (C = 1); sums by windows over all rows
_PLANE = f"""WITH RECURSIVE learn AS {S.LEARN},
ipm(it, x0, x1, y, a, xi, t, v0, v1, vb, s, left_over) AS (
  SELECT 0, x0, x1, CAST(2 * y - 1 AS DOUBLE), 0.5::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
         0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM learn
  UNION ALL
  SELECT it + 1, x0, x1, y, a + st * da, xi + st * dx, t + st * dt, v0 + st * d0, v1 + st * d1, vb + st * db, st, comp
  FROM (SELECT *, least(1.0, 0.99 * min(least(
          CASE WHEN da < 0 THEN a / -da ELSE 1e300 END, CASE WHEN da > 0 THEN b / da ELSE 1e300 END,
          CASE WHEN dt < 0 THEN t / -dt ELSE 1e300 END, CASE WHEN dx < 0 THEN xi / -dx ELSE 1e300 END)) OVER ()) AS st
  FROM (SELECT *, (mu - a * t - t * da) / a AS dt, (mu - b * xi + xi * da) / b AS dx
  FROM (SELECT *, (mu * (1 / a - 1 / b) + xi - t - y * (d0 * x0 + d1 * x1 + db)) / dd AS da
  FROM (SELECT *, (A11 * q0 + A12 * q1 + A13 * qb) / det AS d0, (A12 * q0 + A22 * q1 + A23 * qb) / det AS d1,
               (A13 * q0 + A23 * q1 + A33 * qb) / det AS db
  FROM (SELECT *, m00 * A11 + m01 * A12 + m0b * A13 AS det
  FROM (SELECT *, m11 * mbb - m1b * m1b AS A11, m0b * m1b - m01 * mbb AS A12, m01 * m1b - m0b * m11 AS A13,
               m00 * mbb - m0b * m0b AS A22, m01 * m0b - m00 * m1b AS A23, m00 * m11 - m01 * m01 AS A33,
               u0 - v0 + mu * p0 + r0 AS q0, u1 - v1 + mu * p1 + r1 AS q1, ub + mu * pb + rb AS qb
  FROM (SELECT *, comp / (2 * n) * CASE WHEN s > 0.9 THEN 0.03 WHEN s > 0.5 THEN 0.1 ELSE 0.5 END AS mu
  FROM (SELECT *, 1 + sum(x0 * x0 / dd) OVER () AS m00, sum(x0 * x1 / dd) OVER () AS m01, sum(x0 / dd) OVER () AS m0b,
               1 + sum(x1 * x1 / dd) OVER () AS m11, sum(x1 / dd) OVER () AS m1b, sum(1 / dd) OVER () AS mbb,
               sum(a * y * x0) OVER () AS u0, sum(a * y * x1) OVER () AS u1, sum(a * y) OVER () AS ub,
               sum(y * (1 / a - 1 / b) / dd * x0) OVER () AS p0, sum(y * (1 / a - 1 / b) / dd * x1) OVER () AS p1,
               sum(y * (1 / a - 1 / b) / dd) OVER () AS pb, sum(y * (xi - t) / dd * x0) OVER () AS r0,
               sum(y * (xi - t) / dd * x1) OVER () AS r1, sum(y * (xi - t) / dd) OVER () AS rb,
               sum(a * t + b * xi) OVER () AS comp, count(*) OVER () AS n
  FROM (SELECT *, xi / b + t / a AS dd FROM (SELECT *, 1 - a AS b FROM ipm WHERE it < 40 AND left_over > 1e-7))))))))))),
fin AS (SELECT * FROM ipm QUALIFY it = max(it) OVER ())
SELECT round(any_value(v0), 3) AS w0, round(any_value(v1), 3) AS w1, round(any_value(vb), 3) AS intercept,
       round(any_value(v0 * v0 + v1 * v1) / 2 + sum(greatest(0, 1 - y * (v0 * x0 + v1 * x1 + vb))), 4) AS objective,
       true AS closed FROM fin"""


@query("svm_linear_plane", _PLANE)
def svm_linear_plane(spark, sf):
    """The plane, its objective and whether the duality gap is closed."""
    df = tb.f_learn(spark, sf)
    m = svm.fit(df, ["x0", "x1"], "y", C=1.0, kernel="linear", id="vec_id")
    _, _, w, b = m.pairs[0]
    f = F.lit(b) + F.lit(float(w[0])) * F.col("x0") + F.lit(float(w[1])) * F.col("x1")
    loss = df.agg(F.sum(F.greatest(F.lit(0.0), 1 - (2 * F.col("y") - 1) * f))).first()[0]
    objective = float(w @ w) / 2 + loss
    return rounded(spark.createDataFrame(
        [(float(w[0]), float(w[1]), float(b), objective, abs(m.gaps[0]) < 1e-7 * objective)],
        "w0 double, w1 double, intercept double, objective double, closed boolean"), 4).select(
        *[F.round(c, 3).alias(c) for c in ("w0", "w1", "intercept")], "objective", "closed")


@query("svm_multiclass")
def svm_multiclass(spark, sf):
    ev = tb.f_event(spark, sf)
    m = svm.fit(ev, ["value", "hour"], "event_type", kernel="linear", id="event_id")
    return m.predict(ev, "event_id", keep=["event_type"])


@query("svm_support_counts")
def svm_support_counts(spark, sf):
    df = tb.f_learn(spark, sf)
    m = svm.fit(df, ["x0", "x1"], "y", kernel="linear", id="vec_id")
    return svm.support_counts(m, df, "y", "vec_id")


# ---- cross validation with k-NN (SQL-checkable) -------------------------------------
_FOLDS = f"""learn AS {S.LEARN},
cls AS (SELECT y, count(*) AS nk, min(vec_id) AS fst FROM learn GROUP BY y),
c2 AS (SELECT y, nk, coalesce(sum(nk) OVER (ORDER BY fst
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM cls),
pos AS (SELECT l.vec_id, l.y, l.x0, l.x1, c2.nk, c2.st,
           row_number() OVER (PARTITION BY l.y ORDER BY l.vec_id) - 1 AS j
        FROM learn l JOIN c2 USING (y)),
al AS (SELECT p.*, f.f,
          greatest(0, CAST(ceil((nk - (((f.f - st) % 5) + 5) % 5) / 5.0) AS BIGINT)) AS a
       FROM pos p, range(0, 5) f(f)),
cum AS (SELECT vec_id, j, f, sum(a) OVER (PARTITION BY vec_id ORDER BY f) AS b FROM al),
fo AS (SELECT vec_id, CAST(sum(CASE WHEN f < 4 AND j >= b THEN 1 ELSE 0 END) AS INTEGER) AS fold
       FROM cum GROUP BY vec_id),
d AS (SELECT l.*, fo.fold FROM learn l JOIN fo USING (vec_id))"""

_CV_KNN = f"""WITH {_FOLDS},
pr AS (SELECT t.fold, t.vec_id AS q, t.y AS ty, r.vec_id AS r, r.y AS lab,
              sqrt((t.x0 - r.x0) * (t.x0 - r.x0) + (t.x1 - r.x1) * (t.x1 - r.x1)) AS dd
       FROM d t JOIN d r ON t.fold <> r.fold),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, q ORDER BY round(dd, 9), r)
                      AS rk FROM pr) WHERE rk <= 5),
v AS (SELECT fold, q, any_value(ty) AS ty, sum(CASE WHEN lab = 0 THEN 1 ELSE 0 END) AS v0,
             sum(CASE WHEN lab = 1 THEN 1 ELSE 0 END) AS v1 FROM nb GROUP BY fold, q),
sc AS (SELECT fold, avg(CASE WHEN (CASE WHEN v0 >= v1 THEN 0 ELSE 1 END) = ty THEN 1.0 ELSE 0.0 END)
              AS score, count(*) AS n_test FROM v GROUP BY fold)"""


def _cv(spark, sf):
    return se.cross_validate(tb.f_learn(spark, sf), ["x0", "x1"], "y", "knn", 5, "accuracy",
                             "vec_id")


@query("cross_validate", _CV_KNN + """
SELECT fold, round(score, 6) AS score, CAST((SELECT count(*) FROM learn) - n_test AS BIGINT)
       AS n_train, CAST(n_test AS BIGINT) AS n_test FROM sc""")
def cross_validate(spark, sf):
    return rounded(_cv(spark, sf))


@query("cv_summary", _CV_KNN + """
SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
       round(min(score), 6) AS min, round(max(score), 6) AS max FROM sc""")
def cv_summary(spark, sf):
    return rounded(se.cv_summary(_cv(spark, sf)))


_CV_NB = f"""WITH {_FOLDS},
ll AS (SELECT vec_id, y, fold, 0 AS pos, x0 AS x FROM d UNION ALL SELECT vec_id, y, fold, 1, x1 FROM d),
tr AS (SELECT f.f AS f, ll.* FROM range(0, 5) f(f) JOIN ll ON ll.fold <> f.f),
st AS (SELECT f, y AS c, pos, avg(x) AS m, var_pop(x) AS v, count(*) AS nc FROM tr GROUP BY f, y, pos),
ep AS (SELECT f, 1e-9 * max(v) AS e FROM (SELECT f, pos, var_pop(x) AS v FROM tr GROUP BY f, pos) GROUP BY f),
jl AS (SELECT ll.fold, ll.vec_id, any_value(ll.y) AS y, st.c, ln(any_value(st.nc))
          + sum(-0.5 * ln(2 * pi() * (v + e)) - 0.5 * (x - m) * (x - m) / (v + e)) AS jll
       FROM ll JOIN st ON st.f = ll.fold AND st.pos = ll.pos JOIN ep ON ep.f = ll.fold
       GROUP BY ll.fold, ll.vec_id, st.c),
pr AS (SELECT fold, vec_id, y, c AS p FROM jl
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY jll DESC, c) = 1),
cl AS (SELECT fold, k.c, count(*) FILTER (WHERE y = k.c AND p = k.c) AS tp,
              count(*) FILTER (WHERE y = k.c) + count(*) FILTER (WHERE p = k.c) AS marked
       FROM pr, (SELECT DISTINCT y AS c FROM d) k GROUP BY fold, k.c),
f1 AS (SELECT fold, avg(2.0 * tp / marked) AS score FROM cl WHERE marked > 0 GROUP BY fold),
nt AS (SELECT fold, count(*) AS n_test FROM d GROUP BY fold)"""


@query("cross_validate_f1_macro", _CV_NB + """
SELECT fold, round(score, 6) AS score, CAST((SELECT count(*) FROM d) - n_test AS BIGINT) AS n_train,
       CAST(n_test AS BIGINT) AS n_test FROM f1 JOIN nt USING (fold)""")
def cross_validate_f1_macro(spark, sf):
    return rounded(se.cross_validate(tb.f_learn(spark, sf), ["x0", "x1"], "y", "nb", 5,
                                     "f1_macro", "vec_id"))


# Newton's method as in logistic_l2, for the training rows of all folds at once
_CV_LOGIT = f"""WITH RECURSIVE {_FOLDS},
it(k, f, b0, b1, b2) AS (
  SELECT 0, CAST(f AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM range(0, 5) r(f)
  UNION ALL
  SELECT k + 1, f, b0 - (A11 * g0 + A12 * g1 + A13 * g2) / det, b1 - (A12 * g0 + A22 * g1 + A23 * g2) / det,
         b2 - (A13 * g0 + A23 * g1 + A33 * g2) / det
  FROM (SELECT *, a * A11 + b * A12 + c * A13 AS det FROM (
    SELECT *, d * h - e * e AS A11, c * e - b * h AS A12, b * e - c * d AS A13,
              a * h - c * c AS A22, b * c - a * e AS A23, a * d - b * b AS A33 FROM (
      SELECT k, f, b0, b1, b2, sum(s - y) AS g0, sum((s - y) * x0) + b1 AS g1, sum((s - y) * x1) + b2 AS g2,
             sum(s * (1 - s)) AS a, sum(s * (1 - s) * x0) AS b, sum(s * (1 - s) * x1) AS c,
             sum(s * (1 - s) * x0 * x0) + 1 AS d, sum(s * (1 - s) * x0 * x1) AS e, sum(s * (1 - s) * x1 * x1) + 1 AS h
      FROM (SELECT it.*, t.x0, t.x1, t.y, 1 / (1 + exp(-(b0 + b1 * t.x0 + b2 * t.x1))) AS s
            FROM it JOIN d t ON t.fold <> it.f WHERE it.k < 12) GROUP BY k, f, b0, b1, b2)))),
sc AS (SELECT t.fold, avg(CASE WHEN (b0 + b1 * t.x0 + b2 * t.x1 > 0) = (t.y = 1) THEN 1.0 ELSE 0.0 END) AS score,
              count(*) AS n_test FROM d t JOIN it ON it.f = t.fold WHERE it.k = 12 GROUP BY t.fold)"""


@query("cross_validate_logistic", _CV_LOGIT + """
SELECT fold, round(score, 4) AS score, CAST((SELECT count(*) FROM d) - n_test AS BIGINT) AS n_train,
       CAST(n_test AS BIGINT) AS n_test FROM sc""")
def cross_validate_logistic(spark, sf):
    return rounded(se.cross_validate(tb.f_learn(spark, sf), ["x0", "x1"], "y", "logistic", 5,
                                     "accuracy", "vec_id"), 4)


# ---- grid search over k for k-NN (SQL-checkable) -------------------------------------
_KS = [1, 3, 5, 7]
_GRID = f"""WITH {_FOLDS},
pr AS (SELECT t.fold, t.vec_id AS q, t.y AS ty, r.vec_id AS r, r.y AS lab,
              sqrt((t.x0 - r.x0) * (t.x0 - r.x0) + (t.x1 - r.x1) * (t.x1 - r.x1)) AS dd
       FROM d t JOIN d r ON t.fold <> r.fold),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, q ORDER BY round(dd, 9), r)
                      AS rk FROM pr) WHERE rk <= 7),
ks AS (SELECT * FROM (VALUES {', '.join(f'({i}, {k})' for i, k in enumerate(_KS))}) v(cand, k)),
v AS (SELECT cand, fold, q, any_value(ty) AS ty,
             sum(CASE WHEN lab = 0 THEN 1 ELSE 0 END) AS v0,
             sum(CASE WHEN lab = 1 THEN 1 ELSE 0 END) AS v1
      FROM nb JOIN ks ON nb.rk <= ks.k GROUP BY cand, fold, q),
sc AS (SELECT cand, fold,
              avg(CASE WHEN (CASE WHEN v0 >= v1 THEN 0 ELSE 1 END) = ty THEN 1.0 ELSE 0.0 END)
              AS score FROM v GROUP BY cand, fold),
g AS (SELECT cand, avg(score) AS mean, stddev_pop(score) AS std FROM sc GROUP BY cand),
r AS (SELECT g.*, 'n_neighbors=' || CAST(k AS VARCHAR) AS params,
             CAST(row_number() OVER (ORDER BY mean DESC, cand) AS BIGINT) AS rank
      FROM g JOIN ks USING (cand))"""


def _grid(spark, sf):
    return se.grid_search(tb.f_learn(spark, sf), ["x0", "x1"], "y", {"n_neighbors": _KS},
                          "knn", 5, "accuracy", "vec_id")


@query("grid_search", _GRID + """
SELECT CAST(cand AS INTEGER) AS candidate, params, round(mean, 6) AS mean, round(std, 6) AS std,
       rank, rank = 1 AS best FROM r""")
def grid_search(spark, sf):
    return rounded(_grid(spark, sf))


@query("grid_top10", _GRID + """
SELECT CAST(cand AS INTEGER) AS candidate, params, round(mean, 6) AS mean, round(std, 6) AS std,
       rank, rank = 1 AS best FROM r WHERE rank <= 10""")
def grid_top10(spark, sf):
    return rounded(se.grid_top(_grid(spark, sf), 10))


@query("grid_search_svm")
def grid_search_svm(spark, sf):
    """The reference's default grid: C in (0.1, 1, 10) x kernel in (rbf, linear)."""
    return rounded(se.grid_search(tb.f_learn(spark, sf), ["x0", "x1"], "y",
                                  {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]}, "svm", 5,
                                  "accuracy", "vec_id"), 4)


# ---- learning curve with k-NN (SQL-checkable) ------------------------------------------
_FRACS = [0.1, 0.3, 0.5, 0.7, 1.0]
_LC = f"""WITH {_FOLDS},
nmax AS (SELECT count(*) FILTER (WHERE fold <> 0) AS m FROM d),
sz AS (SELECT DISTINCT CAST(floor(fr * m) AS INTEGER) AS s
       FROM nmax, (VALUES {', '.join(f'({f})' for f in _FRACS)}) v(fr)),
trp AS (SELECT f.f AS fold, d.*, row_number() OVER (PARTITION BY f.f ORDER BY d.vec_id) - 1 AS pos
        FROM range(0, 5) f(f) JOIN d ON d.fold <> f.f),
sub AS (SELECT sz.s, trp.* FROM sz JOIN trp ON trp.pos < sz.s),
qs AS (SELECT s, fold, vec_id, y, x0, x1, 'val' AS kind FROM sz, d
           JOIN (SELECT DISTINCT fold AS ff FROM d) x ON d.fold = x.ff
       UNION ALL SELECT s, fold, vec_id, y, x0, x1, 'train' FROM sub),
qq AS (SELECT qs.s, x.f AS fold, qs.vec_id, qs.y, qs.x0, qs.x1, qs.kind FROM qs
       JOIN range(0, 5) x(f) ON (qs.kind = 'val' AND qs.fold = x.f)
                             OR (qs.kind = 'train' AND qs.fold = x.f)),
pr AS (SELECT q.s, q.fold, q.kind, q.vec_id AS q, q.y AS ty, r.vec_id AS r, r.y AS lab,
              sqrt((q.x0 - r.x0) * (q.x0 - r.x0) + (q.x1 - r.x1) * (q.x1 - r.x1)) AS dd
       FROM qq q JOIN sub r ON r.s = q.s AND r.fold = q.fold),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, fold, kind, q
                                                   ORDER BY round(dd, 9), r) AS rk FROM pr)
       WHERE rk <= 5),
v AS (SELECT s, fold, kind, q, any_value(ty) AS ty,
             sum(CASE WHEN lab = 0 THEN 1 ELSE 0 END) AS v0,
             sum(CASE WHEN lab = 1 THEN 1 ELSE 0 END) AS v1 FROM nb GROUP BY s, fold, kind, q),
sc AS (SELECT s, fold, kind,
              avg(CASE WHEN (CASE WHEN v0 >= v1 THEN 0 ELSE 1 END) = ty THEN 1.0 ELSE 0.0 END)
              AS score FROM v GROUP BY s, fold, kind),
cur AS (SELECT s AS train_size, avg(score) FILTER (WHERE kind = 'train') AS train_mean,
               stddev_pop(score) FILTER (WHERE kind = 'train') AS train_std,
               avg(score) FILTER (WHERE kind = 'val') AS val_mean,
               stddev_pop(score) FILTER (WHERE kind = 'val') AS val_std FROM sc GROUP BY s)"""


def _curve(spark, sf):
    return se.learning_curve(tb.f_learn(spark, sf), ["x0", "x1"], "y", "knn", 5, _FRACS,
                             "vec_id")


@query("learning_curve", _LC + """
SELECT train_size, round(train_mean, 6) AS train_mean, round(train_std, 6) AS train_std,
       round(val_mean, 6) AS val_mean, round(val_std, 6) AS val_std,
       round(train_mean - val_mean, 6) AS gap FROM cur""")
def learning_curve(spark, sf):
    return rounded(_curve(spark, sf))


@query("fit_diagnosis", _LC + """,
o AS (SELECT *, row_number() OVER (ORDER BY train_size) AS i, count(*) OVER () AS n FROM cur),
a AS (SELECT max(CASE WHEN i = n THEN val_mean END) AS fv, max(CASE WHEN i = n THEN train_mean END)
             AS ft, max(CASE WHEN i = 1 THEN val_mean END) AS v0, max(n) AS n FROM o)
SELECT CASE WHEN fv < 0.7 THEN 'underfit' WHEN ft - fv > 0.15 THEN 'overfit' ELSE 'good' END
       AS status, (n >= 2 AND fv - v0 > 0.05) AS more_data_helps,
       round(ft, 6) AS final_train, round(fv, 6) AS final_val, round(ft - fv, 6) AS gap FROM a""")
def fit_diagnosis(spark, sf):
    return rounded(se.fit_diagnosis(_curve(spark, sf)))
