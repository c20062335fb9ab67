"""Registered queries: splits, naive Bayes, reports, confusion, ROC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes as nb
from ..operators import metrics as mt
from ..operators import roc
from ..operators import split as spl
from ..sources import tables as tb
from . import sqlparts as S
from .registry import query, rounded
from ..session import cut_lineage

EMB_CLASSES = list(range(10))


# ---- Spark side ---------------------------------------------------------------
def emb_nb_predictions(spark, sf):
    """Flagship chain: stratified split -> Gaussian NB (64 dims) -> test predictions."""
    df = tb.f_emb(spark, sf)
    sp = spl.train_test_split(df, "vec_id", 0.2, 42, stratify="label")
    sp = cut_lineage(sp)
    model = nb.fit(sp.where(F.col("split") == "train"), tb.emb_features(), "label")
    return model.predict(sp.where(F.col("split") == "test"), "vec_id", keep=["label"])


def learn_nb_predictions(spark, sf):
    df = tb.f_learn(spark, sf)
    sp = spl.train_test_split(df, "vec_id", 0.2, 42, stratify="y")
    sp = cut_lineage(sp)
    model = nb.fit(sp.where(F.col("split") == "train"), ["x0", "x1"], "y")
    return model.predict(sp.where(F.col("split") == "test"), "vec_id", keep=["y"])


# ---- SQL side -------------------------------------------------------------------
_EMB_PRED = f"""
sp AS {S.stratified_split('embeddings', 'vec_id', 'label')},
e AS {S.EMB},
tr AS (SELECT e.* FROM e JOIN sp USING (vec_id) WHERE split = 'train'),
te AS (SELECT e.* FROM e JOIN sp USING (vec_id) WHERE split = 'test'),
jl AS {S.gaussian_nb('tr', 'te', 'label', 'vec_id')},
pp AS {S.argmax_proba('jl', EMB_CLASSES)},
pred AS (SELECT pp.id AS vec_id, sp.label, pp.* EXCLUDE (id) FROM pp JOIN sp ON pp.id = sp.vec_id)"""

_LEARN_PRED = f"""
learn AS {S.LEARN},
sp AS {S.stratified_split('learn', 'vec_id', 'y')},
ll AS {S.LEARN_LONG},
tr AS (SELECT ll.* FROM ll JOIN sp USING (vec_id) WHERE split = 'train'),
te AS (SELECT ll.* FROM ll JOIN sp USING (vec_id) WHERE split = 'test'),
jl AS {S.gaussian_nb('tr', 'te', 'y', 'vec_id')},
pp AS {S.argmax_proba('jl', [0, 1])},
pred AS (SELECT pp.id AS vec_id, sp.y, pp.* EXCLUDE (id) FROM pp JOIN sp ON pp.id = sp.vec_id)"""


def _round_cols(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---- splits (E1-E5) -----------------------------------------------------------
@query("train_test_split", f"""
WITH learn AS {S.LEARN}
SELECT vec_id, y, CASE WHEN row_number() OVER (
    ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id) - 1
    < CAST(ceil(0.2::DOUBLE * count(*) OVER ()) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM learn""")
def train_test_split(spark, sf):
    return spl.train_test_split(tb.f_learn(spark, sf), "vec_id", 0.2, 42).select(
        "vec_id", "y", "split")


@query("train_test_split_ordered", f"""
WITH learn AS {S.LEARN}
SELECT vec_id, y, CASE WHEN row_number() OVER (ORDER BY vec_id) - 1
    >= count(*) OVER () - CAST(ceil(0.2::DOUBLE * count(*) OVER ()) AS BIGINT)
    THEN 'test' ELSE 'train' END AS split FROM learn""")
def train_test_split_ordered(spark, sf):
    return spl.train_test_split(tb.f_learn(spark, sf), "vec_id", 0.2, 42,
                                shuffle=False).select("vec_id", "y", "split")


_EV_SPLIT = f"ev AS {S.EVENT}, sp AS {S.stratified_split('ev', 'event_id', 'event_type')}"


def _event_split(spark, sf):
    return spl.train_test_split(tb.f_event(spark, sf), "event_id", 0.2, 42,
                                stratify="event_type")


@query("train_test_split_stratified", f"WITH {_EV_SPLIT} SELECT * FROM sp")
def train_test_split_stratified(spark, sf):
    return _event_split(spark, sf).select("event_id", "event_type", "split")


@query("split_class_distribution", f"""
WITH {_EV_SPLIT}
SELECT event_type, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       CAST(count(*) AS BIGINT) AS n_total FROM sp GROUP BY event_type""")
def split_class_distribution(spark, sf):
    return spl.split_class_distribution(_event_split(spark, sf), "event_type")


@query("split_shapes", f"""
WITH {_EV_SPLIT}
SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(3 AS INTEGER) AS features
FROM sp GROUP BY split""")
def split_shapes(spark, sf):
    return spl.split_shapes(_event_split(spark, sf), 3)


@query("stratified_folds", f"""
WITH ev AS {S.EVENT},
cls AS (SELECT event_type, count(*) AS nk, min(event_id) AS fst FROM ev GROUP BY event_type),
c2 AS (SELECT event_type, nk, coalesce(sum(nk) OVER (ORDER BY fst
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM cls),
pos AS (SELECT ev.event_id, ev.event_type, c2.nk, c2.st,
           row_number() OVER (PARTITION BY ev.event_type ORDER BY ev.event_id) - 1 AS j
        FROM ev JOIN c2 USING (event_type)),
al AS (SELECT p.*, f.f,
          greatest(0, CAST(ceil((nk - (((f.f - st) % 5) + 5) % 5) / 5.0) AS BIGINT)) AS a
       FROM pos p, range(0, 5) f(f)),
cum AS (SELECT event_id, event_type, j, f,
           sum(a) OVER (PARTITION BY event_id ORDER BY f) AS b FROM al)
SELECT event_id, event_type, CAST(sum(CASE WHEN f < 4 AND j >= b THEN 1 ELSE 0 END) AS INTEGER)
       AS fold FROM cum GROUP BY event_id, event_type""")
def stratified_folds(spark, sf):
    return spl.stratified_folds(tb.f_event(spark, sf), "event_type", 5, "event_id").select(
        "event_id", "event_type", "fold")


# ---- naive Bayes (C21-C23), X1-X3 ----------------------------------------------
@query("nb_gaussian", "WITH " + _EMB_PRED + " SELECT vec_id, label, prediction, "
       + _round_cols([f"p_{c}" for c in EMB_CLASSES]) + " FROM pred")
def nb_gaussian(spark, sf):
    return rounded(emb_nb_predictions(spark, sf))


_COUNT_DIMS = 8
_COUNT_LONG = f"""(SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS pos,
    floor(abs(CAST(embedding[i] AS DOUBLE)) * 100) AS x,
    CASE WHEN embedding[i] > 0 THEN 1.0 ELSE 0.0 END AS b
    FROM embeddings, range(1, {_COUNT_DIMS + 1}) r(i))"""


def _discrete_nb_sql(kind):
    if kind == "multinomial":
        par = """th AS (SELECT c, pos, ln(fc + 1.0) - ln(sum(fc + 1.0) OVER (PARTITION BY c)) AS lt
                  FROM (SELECT label AS c, pos, sum(x) AS fc FROM cl GROUP BY 1, 2)),
        ll AS (SELECT cl.vec_id AS id, th.c, sum(cl.x * th.lt) AS s
               FROM cl JOIN th ON cl.pos = th.pos GROUP BY 1, 2)"""
    else:
        par = """th AS (SELECT c, pos, ln((fc + 1.0) / (nc + 2.0)) AS lt,
                        ln(1 - (fc + 1.0) / (nc + 2.0)) AS ln1
                  FROM (SELECT label AS c, pos, sum(b) AS fc, count(*) AS nc FROM cl GROUP BY 1, 2)),
        ll AS (SELECT cl.vec_id AS id, th.c, sum(cl.b * th.lt + (1 - cl.b) * th.ln1) AS s
               FROM cl JOIN th ON cl.pos = th.pos GROUP BY 1, 2)"""
    return f"""
WITH cl AS {_COUNT_LONG},
pr AS (SELECT c, ln(CAST(nc AS DOUBLE) / sum(nc) OVER ()) AS lp
       FROM (SELECT label AS c, count(*) AS nc FROM embeddings GROUP BY 1)),
{par},
jl AS (SELECT id, ll.c, lp + s AS jll FROM ll JOIN pr ON ll.c = pr.c),
pp AS {S.argmax_proba('jl', EMB_CLASSES)}
SELECT id AS vec_id, prediction, {_round_cols([f'p_{c}' for c in EMB_CLASSES])} FROM pp"""


def _discrete_nb(kind, prefix):
    def run(spark, sf):
        df = tb.f_count(spark, sf, _COUNT_DIMS)
        feats = [f"{prefix}{i}" for i in range(_COUNT_DIMS)]
        model = nb.fit(df, feats, "label", kind)
        return rounded(model.predict(df, "vec_id"))
    return run


query("nb_multinomial", _discrete_nb_sql("multinomial"))(_discrete_nb("multinomial", "c"))
query("nb_bernoulli", _discrete_nb_sql("bernoulli"))(_discrete_nb("bernoulli", "b"))


@query("train_accuracy", f"""
WITH learn AS {S.LEARN}, ll AS {S.LEARN_LONG},
jl AS {S.gaussian_nb('ll', 'll', 'y', 'vec_id')},
pp AS {S.argmax_proba('jl', [0, 1])}
SELECT round(avg(CASE WHEN prediction = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(sum(CASE WHEN prediction = y THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       CAST(count(*) AS BIGINT) AS total
FROM pp JOIN learn ON pp.id = learn.vec_id""")
def train_accuracy(spark, sf):
    df = tb.f_learn(spark, sf)
    model = nb.fit(df, ["x0", "x1"], "y")
    pred = model.predict(df, "vec_id", keep=["y"], proba=False)
    return rounded(mt.accuracy(pred, "y"))


@query("predict_proba", "WITH " + _LEARN_PRED
       + " SELECT vec_id, y, prediction, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1 FROM pred")
def predict_proba(spark, sf):
    return rounded(learn_nb_predictions(spark, sf))


@query("class_summary", """
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) OVER () AS BIGINT) AS n_classes
FROM embeddings GROUP BY label""")
def class_summary(spark, sf):
    return mt.class_summary(tb.f_emb(spark, sf, 1), "label")


# ---- reports (E10-E14) -----------------------------------------------------------
def _report_sql(pred_cte, label):
    return f"""
WITH {pred_cte},
pc AS (SELECT class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(s) AS BIGINT) AS support,
              CAST(sum(p) AS BIGINT) AS predicted FROM (
        SELECT {label} AS class, CASE WHEN {label} = prediction THEN 1 ELSE 0 END AS tp,
               1 AS s, 0 AS p FROM pred
        UNION ALL SELECT prediction, 0, 0, 1 FROM pred) GROUP BY class),
r0 AS (SELECT class,
          CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
          support FROM pc),
rep AS (SELECT class, precision, recall,
          CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
               ELSE 0.0 END AS f1, support FROM r0)"""


@query("classification_report", _report_sql(_EMB_PRED, "label") + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM rep""")
def classification_report(spark, sf):
    pred = emb_nb_predictions(spark, sf)
    return rounded(mt.classification_report(pred, "label"))


@query("report_averages", _report_sql(_EMB_PRED, "label") + """,
a AS (SELECT avg(precision) mp, avg(recall) mr, avg(f1) mf,
             sum(precision * support) / sum(support) wp, sum(recall * support) / sum(support) wr,
             sum(f1 * support) / sum(support) wf, CAST(sum(support) AS BIGINT) n FROM rep)
SELECT 'accuracy' AS average, round(wr, 6) AS precision, round(wr, 6) AS recall,
       round(wr, 6) AS f1, n AS support FROM a
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM a
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM a""")
def report_averages(spark, sf):
    pred = emb_nb_predictions(spark, sf)
    return rounded(mt.report_averages(mt.classification_report(pred, "label")))


@query("confusion_matrix", "WITH " + _EMB_PRED + """,
cm AS (SELECT CAST(label AS VARCHAR) AS actual, prediction FROM pred)
SELECT actual, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE prediction = {c}) AS BIGINT) AS pred_{c}"
    for c in EMB_CLASSES) + """, CAST(count(*) AS BIGINT) AS total FROM cm GROUP BY actual
UNION ALL SELECT 'total', """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE prediction = {c}) AS BIGINT)" for c in EMB_CLASSES)
    + ", CAST(count(*) AS BIGINT) FROM cm")
def confusion_matrix(spark, sf):
    pred = emb_nb_predictions(spark, sf)
    return mt.confusion_matrix(pred, EMB_CLASSES, "label")


@query("binary_metrics", "WITH " + _LEARN_PRED + """,
c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND prediction = 1) AS BIGINT) tp,
             CAST(count(*) FILTER (WHERE y <> 1 AND prediction <> 1) AS BIGINT) tn,
             CAST(count(*) FILTER (WHERE y <> 1 AND prediction = 1) AS BIGINT) fp,
             CAST(count(*) FILTER (WHERE y = 1 AND prediction <> 1) AS BIGINT) fn FROM pred),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS "precision",
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0.0 END AS specificity
      FROM c)
SELECT tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(specificity, 6) AS specificity,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
             ELSE 0.0 END, 6) AS f1 FROM m""")
def binary_metrics(spark, sf):
    return rounded(mt.binary_metrics(learn_nb_predictions(spark, sf), 1, "y"))


@query("overall_accuracy", "WITH " + _EMB_PRED + """
SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       CAST(count(*) AS BIGINT) AS total FROM pred""")
def overall_accuracy(spark, sf):
    return rounded(mt.accuracy(emb_nb_predictions(spark, sf), "label"))


# ---- ROC (E15-E19) ------------------------------------------------------------------
_ROC = "WITH " + _LEARN_PRED + """,
g AS (SELECT CAST(p_1 AS DOUBLE) AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM pred GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tps,
             sum(neg) OVER (ORDER BY threshold DESC) AS fps,
             row_number() OVER (ORDER BY threshold DESC) - 1 AS r,
             lead(pos) OVER (ORDER BY threshold DESC) AS np_,
             lead(neg) OVER (ORDER BY threshold DESC) AS nn_,
             count(*) OVER () AS m, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g),
k AS (SELECT * FROM c WHERE m <= 2 OR r = 0 OR r = m - 1 OR np_ <> pos OR nn_ <> neg),
curve AS (SELECT CAST(row_number() OVER (ORDER BY threshold DESC) AS BIGINT) AS point,
                 threshold, CAST(fps AS DOUBLE) / N AS fpr, CAST(tps AS DOUBLE) / P AS tpr FROM k
          UNION ALL SELECT 0, 'inf'::DOUBLE, 0.0, 0.0),
cj AS (SELECT *, tpr - fpr AS j FROM curve)"""


def _learn_scored(spark, sf):
    return learn_nb_predictions(spark, sf).select("y", F.col("p_1").alias("score"))


@query("roc_curve", _ROC + """
SELECT point, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(j, 6) AS j FROM cj""")
def roc_curve(spark, sf):
    return rounded(roc.curve_points(_learn_scored(spark, sf), "y", "score", 1))


_AUC = _ROC + """,
auc AS (SELECT sum(neg * (2 * tps - pos)) / (2.0 * any_value(P) * any_value(N)) AS auc,
               CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c)"""


@query("roc_auc", _AUC + " SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def roc_auc(spark, sf):
    return rounded(roc.auc(_learn_scored(spark, sf), "y", "score", 1))


@query("roc_best_threshold", _ROC + """
SELECT point, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(j, 6) AS j
FROM cj ORDER BY j DESC, point LIMIT 1""")
def roc_best_threshold(spark, sf):
    return rounded(roc.best_threshold(roc.curve_points(_learn_scored(spark, sf), "y", "score", 1)))


@query("roc_key_points", _ROC + """,
st AS (SELECT greatest(1, count(*) // least(15, count(*))) AS step FROM cj)
SELECT point, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(j, 6) AS j
FROM cj, st WHERE point % step = 0""")
def roc_key_points(spark, sf):
    return rounded(roc.key_points(roc.curve_points(_learn_scored(spark, sf), "y", "score", 1)))


@query("auc_band", _AUC + """
SELECT round(auc, 6) AS auc, CASE WHEN auc >= 0.9 THEN 'excellent' WHEN auc >= 0.8 THEN 'good'
  WHEN auc >= 0.7 THEN 'fair' WHEN auc >= 0.5 THEN 'poor' ELSE 'worse than random' END AS band
FROM auc""")
def auc_band(spark, sf):
    a = roc.auc(_learn_scored(spark, sf), "y", "score", 1)
    return rounded(a.select("auc", roc.auc_band("auc").alias("band")))
