"""Registered queries: trees (C16-C19, R9), forests (C20, R10), importance (E20, E22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest as rf
from ..operators import importance as imp
from ..operators import logistic as lg
from ..operators import search, tree
from ..sources import tables as tb
from . import sqlparts as S
from .models import _newton_sql
from .preprocess import _F_ORDER
from .registry import query, rounded

TREE_X = ["sum_qty", "avg_disc", "avg_tax", "n_items"]
STATUS = ["F", "O", "P"]

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey, {j} AS pos, CAST({c} AS DOUBLE) AS value, o_orderstatus AS y, "
    f"price_k AS t FROM f" for j, c in enumerate(TREE_X)) + ")"


def _imp_sql(cnt, tot, criterion):
    if criterion == "gini":
        sq = "(0.0 + " + " + ".join(f"{c} * {c}" for c in cnt) + ")"
        return f"({tot} - {sq} / {tot})"
    ent = "0.0" + "".join(
        f" - CASE WHEN {c} > 0 THEN {c} * log2({c} / {tot}) ELSE 0.0 END" for c in cnt)
    return f"({ent})"


def _stump_sql(criterion):
    """Best root split in SQL: same candidates, formula and tie rule as the engine."""
    if criterion == "squared_error":
        stats = "count(*) AS n, CAST(count(*) AS DOUBLE) AS W, sum(t) AS S, sum(t * t) AS S2"
        cols = ["n", "W", "S", "S2"]
        imp_t = "(TS2 - TS * TS / TW)"
        imp_l = "(LS2 - LS * LS / LW)"
        imp_r = "((TS2 - LS2) - (TS - LS) * (TS - LS) / (TW - LW))"
        tot = "SELECT count(*) AS Tn, CAST(count(*) AS DOUBLE) AS TW, sum(price_k) AS TS, " \
              "sum(price_k * price_k) AS TS2 FROM f"
    else:
        stats = "count(*) AS n, CAST(count(*) AS DOUBLE) AS W, " + ", ".join(
            f"sum(CASE WHEN y = '{s}' THEN 1.0 ELSE 0.0 END) AS c{i}" for i, s in enumerate(STATUS))
        cols = ["n", "W"] + [f"c{i}" for i in range(3)]
        imp_t = _imp_sql([f"T{i}" for i in range(3)], "TW", criterion)
        imp_l = _imp_sql([f"L{i}" for i in range(3)], "LW", criterion)
        imp_r = _imp_sql([f"(T{i} - L{i})" for i in range(3)], "(TW - LW)", criterion)
        tot = "SELECT count(*) AS Tn, CAST(count(*) AS DOUBLE) AS TW, " + ", ".join(
            f"sum(CASE WHEN o_orderstatus = '{s}' THEN 1.0 ELSE 0.0 END) AS T{i}"
            for i, s in enumerate(STATUS)) + " FROM f"
    cum = ", ".join(f"sum({c}) OVER w AS L{c[1:] if c.startswith('c') else c}" for c in cols)
    cum = cum.replace("AS Ln", "AS Ln_").replace("AS LW", "AS LW").replace("AS LS2", "AS LS2")
    return f"""WITH f AS {_F_ORDER}, {_LONG},
h AS (SELECT pos, value, {stats} FROM long GROUP BY pos, value),
cu AS (SELECT *, {cum}, lead(value) OVER w2 AS nv FROM h
       WINDOW w AS (PARTITION BY pos ORDER BY value ROWS UNBOUNDED PRECEDING),
              w2 AS (PARTITION BY pos ORDER BY value)),
tot AS ({tot}),
cand AS (SELECT pos, CASE WHEN (value + nv) / 2.0 >= nv THEN value ELSE (value + nv) / 2.0 END
                AS thr, {imp_t} - {imp_l} - {imp_r} AS gain, Ln_, Tn - Ln_ AS Rn, Tn
         FROM cu, tot WHERE nv IS NOT NULL AND Ln_ >= 1 AND Tn - Ln_ >= 1),
best AS (SELECT * FROM cand ORDER BY gain DESC, pos, thr LIMIT 1),
nodes AS (
  SELECT CAST(0 AS BIGINT) AS node, 0 AS depth, CAST(Tn AS BIGINT) AS n, false AS is_leaf,
         pos AS feature_pos, thr AS threshold, gain FROM best
  UNION ALL SELECT 1, 1, CAST(Ln_ AS BIGINT), true, NULL, NULL, NULL FROM best
  UNION ALL SELECT 2, 1, CAST(Rn AS BIGINT), true, NULL, NULL, NULL FROM best)"""


def _stump(criterion):
    def run(spark, sf):
        df = tb.f_order(spark, sf)
        y = "price_k" if criterion == "squared_error" else "o_orderstatus"
        return tree.fit(df, TREE_X, y, "o_orderkey", criterion=criterion, max_depth=1)
    return run


_NODE_COLS = ("node", "depth", "n", "is_leaf", "feature_pos", "threshold", "gain")
_NODE_SQL = """
SELECT node, depth, n, is_leaf, CAST(feature_pos AS INTEGER) AS feature_pos,
       round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM nodes"""


def _nodes(criterion):
    def run(spark, sf):
        m = _stump(criterion)(spark, sf)
        return rounded(m.nodes.select(*_NODE_COLS))
    return run


query("tree_gini", _stump_sql("gini") + _NODE_SQL)(_nodes("gini"))
query("tree_entropy", _stump_sql("entropy") + _NODE_SQL)(_nodes("entropy"))
query("tree_regressor", _stump_sql("squared_error") + _NODE_SQL)(_nodes("squared_error"))


@query("tree_shape", _stump_sql("gini") + """
SELECT max(depth) AS depth, CAST(count(*) FILTER (WHERE is_leaf) AS BIGINT) AS n_leaves,
       CAST(count(*) AS BIGINT) AS n_nodes FROM nodes""")
def tree_shape(spark, sf):
    return _stump("gini")(spark, sf).shape()


_TREE_IMP = _stump_sql("gini") + """,
fe AS (SELECT * FROM (VALUES (0, 'sum_qty'), (1, 'avg_disc'), (2, 'avg_tax'),
                             (3, 'n_items')) v(pos, feature))
SELECT CAST(fe.pos AS INTEGER) AS pos, fe.feature,
       round(coalesce(sum(gain) / (SELECT sum(gain) FROM nodes), 0.0), 6) AS importance
FROM fe LEFT JOIN nodes ON nodes.feature_pos = fe.pos GROUP BY fe.pos, fe.feature"""


@query("tree_importance", _TREE_IMP)
def tree_importance(spark, sf):
    return rounded(_stump("gini")(spark, sf).importance())


query("feature_importance_tree", _TREE_IMP)(tree_importance)


# ---- whole trees of three levels ----------------------------------------------------
_DEEP = dict(max_depth=3, min_samples_split=40, min_samples_leaf=5)


def _levels_sql(criterion, source):
    """The CTEs r0.. (training rows by node), best0.. and levels; a node is named by its turns from the root.

    ``source`` has TREE_X, the class ``y`` and the number ``t``.
    """
    if criterion == "squared_error":
        cols = ["n", "W", "S", "S2"]
        sums = "count(*) AS n, CAST(count(*) AS DOUBLE) AS W, sum(t) AS S, sum(t * t) AS S2"
        imp_of = lambda a: f"({a('S2')} - {a('S')} * {a('S')} / {a('W')})"
    else:
        cols = ["n", "W", *[f"c{i}" for i in range(3)]]
        sums = "count(*) AS n, CAST(count(*) AS DOUBLE) AS W, " + ", ".join(
            f"sum(CASE WHEN y = '{s}' THEN 1.0 ELSE 0.0 END) AS c{i}" for i, s in enumerate(STATUS))
        imp_of = lambda a: _imp_sql([a(f"c{i}") for i in range(3)], a("W"), criterion)
    whole, left, right = (imp_of(a) for a in (lambda c: f"T{c}", lambda c: f"L{c}", lambda c: f"(T{c} - L{c})"))
    leaf, depth = _DEEP["min_samples_leaf"], _DEEP["max_depth"]
    sql = f"r0 AS (SELECT s.*, '' AS node FROM {source} s)"
    for d in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {j} AS pos, CAST({c} AS DOUBLE) AS value, y, t FROM r{d}"
                                  for j, c in enumerate(TREE_X))
        sql += f""",
h{d} AS (SELECT node, pos, value, {sums} FROM ({long}) GROUP BY node, pos, value),
cu{d} AS (SELECT node, pos, value, lead(value) OVER o AS nv,
    {", ".join(f"sum({c}) OVER o AS L{c}, sum({c}) OVER g AS T{c}" for c in cols)}
  FROM h{d} WINDOW o AS (PARTITION BY node, pos ORDER BY value ROWS UNBOUNDED PRECEDING),
                   g AS (PARTITION BY node, pos)),
best{d} AS (SELECT node, pos, thr, gain FROM (SELECT node, pos, {whole} - {left} - {right} AS gain,
    CASE WHEN (value + nv) / 2.0 >= nv THEN value ELSE (value + nv) / 2.0 END AS thr FROM cu{d}
    WHERE nv IS NOT NULL AND Tn >= {_DEEP["min_samples_split"]} AND Ln >= {leaf} AND Tn - Ln >= {leaf}
      AND {whole} > 1e-12 * TW)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, pos, thr) = 1),
r{d + 1} AS (SELECT r{d}.* REPLACE (node || {_turn_sql()} AS node) FROM r{d} JOIN best{d} USING (node))"""
    level = lambda d: (
        f"SELECT s.*, {d} AS depth, {'pos, thr, gain' if d < depth else 'NULL AS pos, NULL AS thr, NULL AS gain'} "
        f"FROM (SELECT node, {sums} FROM r{d} GROUP BY node) s " + (f"LEFT JOIN best{d} USING (node)" if d < depth else ""))
    return sql + f""",
levels AS ({" UNION ALL ".join(level(d) for d in range(depth + 1))})"""


def _turn_sql():
    value = " ".join(f"WHEN {j} THEN CAST({c} AS DOUBLE)" for j, c in enumerate(TREE_X))
    return f"CASE WHEN CASE pos {value} END <= thr THEN 'L' ELSE 'R' END"


_TREE_ROWS = f"""WITH f AS {_F_ORDER},
src AS (SELECT o_orderkey, {", ".join(TREE_X)}, o_orderstatus AS y, floor(price_k) AS t FROM f)"""


def _levels(criterion):
    """All nodes of a tree over whole numbers, so that sums are exact in either engine."""
    def run(spark, sf):
        df = tb.f_order(spark, sf).withColumn("thousands", F.floor("price_k").cast("double"))
        y = "thousands" if criterion == "squared_error" else "o_orderstatus"
        m = tree.fit(df, TREE_X, y, "o_orderkey", criterion=criterion, **_DEEP)
        return rounded(m.nodes.select(*_NODE_COLS), 4)
    return run


for _name, _criterion in (("tree_levels", "gini"), ("tree_levels_regressor", "squared_error")):
    query(_name, f"""{_TREE_ROWS}, {_levels_sql(_criterion, "src")}
SELECT CAST(row_number() OVER (ORDER BY depth, node) - 1 AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth,
       CAST(n AS BIGINT) AS n, pos IS NULL AS is_leaf, CAST(pos AS INTEGER) AS feature_pos,
       round(thr, 4) AS threshold, round(gain, 4) AS gain FROM levels""")(_levels(_criterion))

_ROUTED = "".join(f""",
t{d + 1} AS (SELECT t{d}.* REPLACE (CASE WHEN pos IS NULL THEN node ELSE node || {_turn_sql()} END AS node)
  FROM t{d} LEFT JOIN best{d} USING (node))""" for d in range(_DEEP["max_depth"]))


@query("tree_test_predictions", f"""{_TREE_ROWS},
parts AS {S.stratified_split("(SELECT o_orderkey, y FROM src)", "o_orderkey", "y")},
train AS (SELECT src.* FROM src JOIN parts USING (o_orderkey) WHERE split = 'train'),
{_levels_sql("gini", "train")},
t0 AS (SELECT src.*, '' AS node FROM src JOIN parts USING (o_orderkey) WHERE split = 'test'){_ROUTED}
SELECT o_orderkey, t3.y AS o_orderstatus,
       CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'F' WHEN c1 >= c2 THEN 'O' ELSE 'P' END AS prediction,
       round(c0 / W, 6) AS "p_F", round(c1 / W, 6) AS "p_O", round(c2 / W, 6) AS "p_P"
FROM t3 JOIN levels USING (node)""")
def tree_test_predictions(spark, sf):
    """A tree by model name: split, fit on the training rows, predict the test rows."""
    df = tb.f_order(spark, sf)
    return rounded(search.predict_split(df, TREE_X, "o_orderstatus", "tree", "o_orderkey", params=_DEEP))


# ---- forests ---------------------------------------------------------------------
_FOREST = dict(n_estimators=3, max_depth=2, min_samples_split=20, min_samples_leaf=3, seed=42)


def _forest_nodes_sql():
    """Three trees of two levels in SQL: the bags, the features each node looks at, its best split."""
    y = [f"c{i}" for i in range(3)]
    sums = ("count(*) AS n, sum(w) AS W, "
            + ", ".join(f"sum(CASE WHEN y = '{s}' THEN w ELSE 0.0 END) AS {c}" for c, s in zip(y, STATUS)))
    u = "CAST(('0x' || substr(md5(concat('42:', tree, ':', o_orderkey)), 1, 8)) AS BIGINT)"
    weight = " + ".join(f"CASE WHEN {u} >= {t} THEN 1.0 ELSE 0.0 END" for t in rf.POISSON)
    sql = f"""WITH f AS {_F_ORDER},
r0 AS (SELECT * FROM (SELECT f.*, o_orderstatus AS y, tree, CAST(tree AS VARCHAR) AS node,
          CAST({weight} AS DOUBLE) AS w FROM f, range(0, 3) t(tree)) WHERE w > 0),"""
    cols = ["n", "W", *y]
    whole = _imp_sql([f"T{c}" for c in y], "TW", "gini")
    left = _imp_sql([f"L{c}" for c in y], "LW", "gini")
    right = _imp_sql([f"(T{c} - L{c})" for c in y], "(TW - LW)", "gini")
    for d in (0, 1):
        long = " UNION ALL ".join(f"SELECT node, {j} AS pos, CAST({c} AS DOUBLE) AS value, y, w FROM r{d}"
                                  for j, c in enumerate(TREE_X))
        sql += f"""
h{d} AS (SELECT node, pos, value, {sums} FROM ({long}) GROUP BY node, pos, value),
cu{d} AS (SELECT node, pos, value, lead(value) OVER o AS nv,
    {", ".join(f"sum({c}) OVER o AS L{c}, sum({c}) OVER g AS T{c}" for c in cols)}
  FROM h{d} WINDOW o AS (PARTITION BY node, pos ORDER BY value ROWS UNBOUNDED PRECEDING),
                   g AS (PARTITION BY node, pos)),
look{d} AS (SELECT node, pos, row_number() OVER (PARTITION BY node
      ORDER BY md5(concat('42:', node, ':', pos))) - 1 AS o
  FROM (SELECT DISTINCT node FROM r{d}), range(0, 4) p(pos)),
cand{d} AS (SELECT node, pos, o, {whole} - {left} - {right} AS gain,
    CASE WHEN (value + nv) / 2.0 >= nv THEN value ELSE (value + nv) / 2.0 END AS thr
  FROM cu{d} JOIN look{d} USING (node, pos)
  WHERE nv IS NOT NULL AND Tn >= 20 AND Ln >= 3 AND Tn - Ln >= 3 AND {whole} > 1e-12 * TW),
best{d} AS (SELECT * FROM cand{d} QUALIFY row_number() OVER (PARTITION BY node
    ORDER BY CASE WHEN o < 2 THEN 0 ELSE o END, gain DESC, pos, thr) = 1),
r{d + 1} AS (SELECT r{d}.* REPLACE (node || CASE WHEN CASE pos {" ".join(
    f"WHEN {j} THEN CAST({c} AS DOUBLE)" for j, c in enumerate(TREE_X))} END <= thr THEN 'L' ELSE 'R' END AS node)
  FROM r{d} JOIN best{d} USING (node)),"""
    level = lambda d: (
        f"SELECT s.*, {d} AS depth, {'pos, thr, gain' if d < 2 else 'NULL AS pos, NULL AS thr, NULL AS gain'} "
        f"FROM (SELECT node, tree, {sums} FROM r{d} GROUP BY node, tree) s "
        + (f"LEFT JOIN best{d} USING (node)" if d < 2 else ""))
    return sql + f"""
nodes AS ({" UNION ALL ".join(level(d) for d in (0, 1, 2))})
SELECT node, CAST(tree AS INTEGER) AS tree, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n,
       W AS weight, c0, c1, c2, CAST(pos AS INTEGER) AS feature_pos, round(thr, 6) AS threshold,
       round(gain, 6) AS gain FROM nodes"""


@query("forest_nodes", _forest_nodes_sql())
def forest_nodes(spark, sf):
    m = rf.fit(tb.f_order(spark, sf), TREE_X, "o_orderstatus", id="o_orderkey", **_FOREST)
    counts = [F.col("stats")[i].alias(f"c{i}") for i in range(3)]
    return rounded(m.nodes.select("node", "tree", "depth", "n", "weight", *counts, "feature_pos", "threshold",
                                  "gain"))


def _forest_learn(spark, sf, task="classification"):
    df = tb.f_learn(spark, sf)
    y = "y" if task == "classification" else "x1"
    feats = ["x0", "x1"] if task == "classification" else ["x0"]
    return df, rf.fit(df, feats, y, task, n_estimators=100, seed=42, id="vec_id")


@query("forest_classifier")
def forest_classifier(spark, sf):
    df, m = _forest_learn(spark, sf)
    return rounded(m.predict(df, "vec_id", keep=["y"]), 4)


@query("forest_regressor")
def forest_regressor(spark, sf):
    df, m = _forest_learn(spark, sf, "regression")
    return rounded(m.predict(df, "vec_id", keep=["x1"]), 4)


@query("feature_importance_forest")
def feature_importance_forest(spark, sf):
    df, m = _forest_learn(spark, sf)
    return rounded(m.importance(spark), 4)


@query("feature_importance_forest_regression")
def feature_importance_forest_regression(spark, sf):
    m = rf.fit(tb.f_order(spark, sf), TREE_X, "price_k", "regression", n_estimators=10, max_depth=8, seed=42,
               id="o_orderkey")
    return rounded(m.importance(spark), 4)


@query("importance_ranking", _newton_sql("1.0") + """,
i AS (SELECT 0 AS pos, 'x0' AS feature, abs(b1) AS importance FROM c
      UNION ALL SELECT 1, 'x1', abs(b2) FROM c),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, pos) AS BIGINT) AS rank,
             importance / sum(importance) OVER () AS share FROM i),
q AS (SELECT *, sum(share) OVER (ORDER BY importance DESC, pos
                                 ROWS UNBOUNDED PRECEDING) AS cumulative FROM r)
SELECT pos, feature, round(importance, 5) AS importance, rank, round(share, 5) AS share,
       round(cumulative, 5) AS cumulative,
       min(CASE WHEN cumulative >= 0.9 - 1e-12 THEN rank END) OVER () AS n_for_90,
       min(CASE WHEN cumulative >= 0.95 - 1e-12 THEN rank END) OVER () AS n_for_95 FROM q""")
def importance_ranking(spark, sf):
    m = lg.fit(tb.f_learn(spark, sf), ["x0", "x1"], "y", C=1.0, penalty="l2")
    rows = [(j, f, float(abs(m.coef[0, j]))) for j, f in enumerate(m.features)]
    t = spark.createDataFrame(rows, "pos int, feature string, importance double")
    return rounded(imp.ranking(t), 5)
