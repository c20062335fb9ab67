"""Registered queries: k-NN classifier (C6-C8) and KNN imputation (P13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn as kn
from ..operators import split as spl
from ..sources import tables as tb
from . import sqlparts as S
from .preprocess import NULL_FEATURES, _F_NULL
from .registry import query, rounded
from ..session import cut_lineage


def _learn_split(spark, sf):
    df = tb.f_learn(spark, sf)
    sp = spl.train_test_split(df, "vec_id", 0.2, 42, stratify="y")
    sp = cut_lineage(sp)
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def _knn(weights="uniform", p=2.0, train_as_test=False):
    def run(spark, sf):
        tr, te = _learn_split(spark, sf)
        if train_as_test:
            te = tr
        return rounded(kn.classify(tr, te, ["x0", "x1"], "y", 5, weights, p, "vec_id",
                                   keep=["y"]))
    return run


def _dist_sql(p):
    if p == 1:
        return "abs(t.x0 - r.x0) + abs(t.x1 - r.x1)"
    if p == 2:
        return "sqrt((t.x0 - r.x0) * (t.x0 - r.x0) + (t.x1 - r.x1) * (t.x1 - r.x1))"
    return f"pow(pow(abs(t.x0 - r.x0), {p}) + pow(abs(t.x1 - r.x1), {p}), 1.0 / {p})"


def _knn_sql(weights="uniform", p=2, train_as_test=False):
    test_set = "train" if train_as_test else "test"
    if weights == "uniform":
        w = "1.0"
    else:
        w = "CASE WHEN zero = 1 THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / d END"
    return f"""WITH learn AS {S.LEARN},
sp AS {S.stratified_split('learn', 'vec_id', 'y')},
tr AS (SELECT l.* FROM learn l JOIN sp USING (vec_id) WHERE split = 'train'),
te AS (SELECT l.* FROM learn l JOIN sp USING (vec_id) WHERE split = '{test_set}'),
pr AS (SELECT t.vec_id AS q, r.vec_id AS r, r.y AS lab, {_dist_sql(p)} AS d
       FROM te t, tr r),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), r) AS rk
                      FROM pr) WHERE rk <= 5),
nz AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS zero FROM nb),
v AS (SELECT q, sum(CASE WHEN lab = 0 THEN {w} ELSE 0.0 END) AS v0,
             sum(CASE WHEN lab = 1 THEN {w} ELSE 0.0 END) AS v1 FROM nz GROUP BY q)
SELECT q AS vec_id, te.y, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END AS prediction,
       round(v0 / (v0 + v1), 6) AS p_0, round(v1 / (v0 + v1), 6) AS p_1
FROM v JOIN te ON v.q = te.vec_id"""


query("knn_uniform", _knn_sql())(_knn())
query("knn_distance", _knn_sql("distance"))(_knn("distance"))
query("knn_manhattan", _knn_sql(p=1))(_knn(p=1.0))
query("knn_minkowski", _knn_sql(p=3))(_knn(p=3.0))
query("knn_train_predictions", _knn_sql(train_as_test=True))(_knn(train_as_test=True))


_CLASSES = range(10)


@query("knn_uniform_64", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sp AS {S.stratified_split('e', 'vec_id', 'label')},
nb AS (SELECT * FROM (
  SELECT t.vec_id AS q, r.label AS lab,
         row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_distance(t.x, r.x), 9), r.vec_id) AS rk
  FROM e t JOIN sp st ON st.vec_id = t.vec_id AND st.split = 'test',
       e r JOIN sp sr ON sr.vec_id = r.vec_id AND sr.split = 'train') WHERE rk <= 5),
v AS (SELECT q, lab, count(*) AS n FROM nb GROUP BY q, lab),
best AS (SELECT q, min(struct_pack(n := -n, lab := lab)).lab AS prediction,
                {', '.join(f"round(sum(CASE WHEN lab = {c} THEN n ELSE 0 END) / 5.0, 6) AS p_{c}" for c in _CLASSES)}
         FROM v GROUP BY q)
SELECT q AS vec_id, CAST(e.label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction,
       {', '.join(f'p_{c}' for c in _CLASSES)}
FROM best JOIN e ON e.vec_id = q""")
def knn_uniform_64(spark, sf):
    """All 64 dimensions, ten classes."""
    df = tb.f_emb(spark, sf)
    sp = cut_lineage(spl.train_test_split(df, "vec_id", 0.2, 42, stratify="label"))
    return rounded(kn.classify(sp.where("split = 'train'"), sp.where("split = 'test'"), tb.emb_features(), "label", 5,
                               "uniform", 2.0, "vec_id", keep=["label"]))


@query("impute_knn", f"""WITH f AS {_F_NULL},
pr AS (SELECT q.p_partkey AS q, r.p_partkey AS r, r.p_size AS v0, r.p_retailprice AS v1,
              q.p_size IS NULL AS m0, q.p_retailprice IS NULL AS m1,
              (CASE WHEN q.p_size IS NOT NULL AND r.p_size IS NOT NULL THEN 1 ELSE 0 END
               + CASE WHEN q.p_retailprice IS NOT NULL AND r.p_retailprice IS NOT NULL
                      THEN 1 ELSE 0 END) AS m,
              coalesce((q.p_size - r.p_size) * (q.p_size - r.p_size), 0)
              + coalesce((q.p_retailprice - r.p_retailprice) * (q.p_retailprice - r.p_retailprice),
                         0) AS s
       FROM f q, f r WHERE q.p_size IS NULL OR q.p_retailprice IS NULL),
dd AS (SELECT *, sqrt(s * 2 / m) AS d FROM pr WHERE m > 0),
c0 AS (SELECT q, avg(v0) AS f0 FROM (SELECT *, row_number() OVER (PARTITION BY q
          ORDER BY round(d, 9), r) AS rk FROM dd WHERE m0 AND v0 IS NOT NULL) WHERE rk <= 5
       GROUP BY q),
c1 AS (SELECT q, avg(v1) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY q
          ORDER BY round(d, 9), r) AS rk FROM dd WHERE m1 AND v1 IS NOT NULL) WHERE rk <= 5
       GROUP BY q),
mm AS (SELECT avg(p_size) AS a0, avg(p_retailprice) AS a1 FROM f)
SELECT p_partkey, round(coalesce(p_size, f0, a0), 6) AS p_size,
       round(coalesce(p_retailprice, f1, a1), 6) AS p_retailprice
FROM f LEFT JOIN c0 ON f.p_partkey = c0.q LEFT JOIN c1 ON f.p_partkey = c1.q, mm""")
def impute_knn(spark, sf):
    return rounded(kn.impute_knn(tb.f_null(spark, sf), NULL_FEATURES, "p_partkey", 5))
