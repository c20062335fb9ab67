"""Registered queries: k-means (K1, K2, K4, K5), silhouette (K3, K13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmeans as km
from ..operators import silhouette as sil
from ..sources import tables as tb
from . import sqlparts as S
from .registry import query, rounded

K = 3
ITERS = 20

_LLOYD = f"""WITH RECURSIVE learn AS {S.LEARN},
init AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS c, x0, x1
         FROM learn ORDER BY vec_id LIMIT {K}),
cent(it, c, x0, x1) AS (
  SELECT 0, c, x0, x1 FROM init
  UNION ALL
  SELECT it + 1, c, avg(px0), avg(px1) FROM (
    SELECT cent.it, l.vec_id, l.x0 AS px0, l.x1 AS px1,
           min(struct_pack(d := (l.x0 - cent.x0) * (l.x0 - cent.x0)
                               + (l.x1 - cent.x1) * (l.x1 - cent.x1), c := cent.c)).c AS c
    FROM learn l, cent WHERE cent.it < {ITERS} GROUP BY cent.it, l.vec_id, l.x0, l.x1)
  GROUP BY it, c),
fin AS (SELECT c, x0, x1 FROM cent WHERE it = {ITERS}),
asg AS (SELECT l.vec_id, min(struct_pack(d := (l.x0 - f.x0) * (l.x0 - f.x0)
                                             + (l.x1 - f.x1) * (l.x1 - f.x1), c := f.c)) AS m
        FROM learn l, fin f GROUP BY l.vec_id)"""


def _model(spark, sf):
    df = tb.f_learn(spark, sf)
    init = km.first_rows_centers(df, ["x0", "x1"], K, "vec_id")
    return df, km.kmeans(df, ["x0", "x1"], K, "vec_id", init_centers=init, max_iter=ITERS)


@query("kmeans", _LLOYD + " SELECT vec_id, CAST(m.c AS INTEGER) AS cluster FROM asg")
def kmeans(spark, sf):
    df, m = _model(spark, sf)
    return m.assign(df, "vec_id").select("vec_id", "cluster")


query("cluster_assignments", _LLOYD + " SELECT vec_id, CAST(m.c AS INTEGER) AS cluster FROM asg")(
    kmeans)


@query("kmeans_inertia", _LLOYD + " SELECT round(sum(m.d), 6) AS inertia FROM asg")
def kmeans_inertia(spark, sf):
    df, m = _model(spark, sf)
    return rounded(m.assign(df, "vec_id").agg(F.sum("d2").alias("inertia")))


@query("cluster_centers", _LLOYD + """
SELECT c AS cluster, 0 AS pos, 'x0' AS feature, round(x0, 6) AS center FROM fin
UNION ALL SELECT c, 1, 'x1', round(x1, 6) FROM fin""")
def cluster_centers(spark, sf):
    _, m = _model(spark, sf)
    return rounded(m.centers_table(spark))


@query("cluster_sizes", _LLOYD + f"""
SELECT CAST(m.c AS INTEGER) AS cluster, CAST(count(*) AS BIGINT) AS size,
       round(count(*) / (SELECT count(*) FROM learn), 6) AS share FROM asg GROUP BY m.c""")
def cluster_sizes(spark, sf):
    df, m = _model(spark, sf)
    return rounded(km.cluster_sizes(m.assign(df, "vec_id"), K))


@query("kmeans_mllib")
def kmeans_mllib(spark, sf):
    """k-means|| init, 10 restarts (the reference's default shape)."""
    df = tb.f_learn(spark, sf)
    m = km.kmeans(df, ["x0", "x1"], K, "vec_id", n_init=10, seed=42)
    return m.assign(df, "vec_id").select("vec_id", "cluster")


# silhouette on given labels: cluster = embeddings.label % 3
_SIL = f"""WITH learn AS {S.LEARN},
lab AS (SELECT l.vec_id, l.x0, l.x1, CAST(e.label % 3 AS INTEGER) AS c
        FROM learn l JOIN embeddings e ON l.vec_id = e.vec_id),
sz AS (SELECT c, count(*) AS n FROM lab GROUP BY c),
pd AS (SELECT a.vec_id, a.c AS own, b.c, sum(sqrt((a.x0 - b.x0) * (a.x0 - b.x0)
                                                  + (a.x1 - b.x1) * (a.x1 - b.x1))) AS s
       FROM lab a, lab b GROUP BY a.vec_id, a.c, b.c),
per AS (SELECT pd.vec_id, own,
               max(CASE WHEN pd.c = own AND n > 1 THEN s / (n - 1) END) AS a,
               max(CASE WHEN pd.c = own THEN n END) AS nown,
               min(CASE WHEN pd.c <> own THEN s / n END) AS b
        FROM pd JOIN sz ON pd.c = sz.c GROUP BY pd.vec_id, own),
ss AS (SELECT vec_id, own, a, b,
              coalesce(CASE WHEN nown <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 0.0) AS s
       FROM per)"""


def _labelled(spark, sf):
    df = tb.f_learn(spark, sf)
    e = tb.read(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("cluster"))
    return df.join(e, "vec_id")


@query("silhouette_samples", _SIL + """
SELECT vec_id, own AS cluster, round(a, 6) AS a, round(b, 6) AS b,
       round(s, 6) AS silhouette FROM ss""")
def silhouette_samples(spark, sf):
    return rounded(sil.silhouette_samples(_labelled(spark, sf), ["x0", "x1"], "cluster",
                                          "vec_id"))


@query("silhouette_score", _SIL + """
SELECT round(avg(s), 6) AS silhouette, CAST(count(*) AS BIGINT) AS n FROM ss""")
def silhouette_score(spark, sf):
    return rounded(sil.silhouette_score(_labelled(spark, sf), ["x0", "x1"], "cluster", "vec_id"))


@query("silhouette_analysis")
def silhouette_analysis(spark, sf):
    """k = 2..6 with MLlib k-means (seed 42, 10 restarts); silhouette per k."""
    df = tb.f_learn(spark, sf)
    return rounded(sil.silhouette_analysis(df, ["x0", "x1"], "vec_id", 2, 6, seed=42), 4)


# ---- DBSCAN (K6, K7) on the first two embedding dims ------------------------------
from ..operators import dbscan as db  # noqa: E402

EPS, MIN_SAMPLES = 0.02, 5

_DBSCAN = f"""WITH RECURSIVE learn AS {S.LEARN},
pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM learn a, learn b
       WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
             <= {EPS!r} * {EPS!r}),
core AS (SELECT a AS v FROM pr GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
ce AS (SELECT a, b FROM pr WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM core)),
reach(a, b) AS (SELECT a, b FROM ce UNION SELECT reach.a, ce.b FROM reach JOIN ce ON reach.b = ce.a),
comp AS (SELECT a AS v, min(b) AS label FROM reach GROUP BY a),
num AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster
        FROM (SELECT DISTINCT label FROM comp)),
cc AS (SELECT v, cluster FROM comp JOIN num USING (label)),
bd AS (SELECT pr.a, min(cc.cluster) AS bc FROM pr JOIN cc ON pr.b = cc.v GROUP BY pr.a),
lab AS (SELECT l.vec_id, CAST(coalesce(cc.cluster, bd.bc, -1) AS INTEGER) AS cluster,
               cc.cluster IS NOT NULL AS is_core
        FROM learn l LEFT JOIN cc ON l.vec_id = cc.v LEFT JOIN bd ON l.vec_id = bd.a)"""


def _dbscan(spark, sf):
    return db.dbscan(tb.f_learn(spark, sf), ["x0", "x1"], EPS, MIN_SAMPLES, "vec_id")


@query("dbscan", _DBSCAN + " SELECT * FROM lab")
def dbscan(spark, sf):
    return _dbscan(spark, sf)


@query("dbscan_summary", _DBSCAN + """
SELECT CAST(count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS BIGINT) AS n_clusters,
       CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise,
       round(count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS noise_share,
       CAST(count(*) FILTER (WHERE is_core) AS BIGINT) AS n_core,
       CAST(count(*) AS BIGINT) AS n FROM lab""")
def dbscan_summary(spark, sf):
    return rounded(db.summary(_dbscan(spark, sf)))


@query("dbscan_silhouette", _DBSCAN + """,
inside AS (SELECT l.vec_id, l.x0, l.x1, lab.cluster AS c FROM learn l JOIN lab USING (vec_id) WHERE cluster >= 0),
sz AS (SELECT c, count(*) AS n FROM inside GROUP BY c),
pd AS (SELECT a.vec_id, a.c AS own, b.c, sum(sqrt((a.x0 - b.x0) * (a.x0 - b.x0)
                                                  + (a.x1 - b.x1) * (a.x1 - b.x1))) AS s
       FROM inside a, inside b GROUP BY a.vec_id, a.c, b.c),
per AS (SELECT pd.vec_id, max(CASE WHEN pd.c = own AND n > 1 THEN s / (n - 1) END) AS a,
               max(CASE WHEN pd.c = own THEN n END) AS nown, min(CASE WHEN pd.c <> own THEN s / n END) AS b
        FROM pd JOIN sz ON pd.c = sz.c GROUP BY pd.vec_id)
SELECT round(avg(coalesce(CASE WHEN nown <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 0.0)), 6) AS silhouette,
       CAST(count(*) AS BIGINT) AS n FROM per""")
def dbscan_silhouette(spark, sf):
    df = tb.f_learn(spark, sf)
    return rounded(db.silhouette(df, _dbscan(spark, sf), ["x0", "x1"], "vec_id"))


# ---- hierarchical (K8, K9) --------------------------------------------------------
from ..operators import hierarchy as hc  # noqa: E402

# Prim's algorithm: each step takes the point nearest to the tree; the row of a point keeps its nearest tree point
_PRIM = f"""WITH RECURSIVE learn AS {S.LEARN},
grown(it, vec_id, x0, x1, done, best, via, taken) AS (
  SELECT 0, l.vec_id, l.x0, l.x1, l.vec_id = f.vec_id,
         sqrt((l.x0 - f.x0) * (l.x0 - f.x0) + (l.x1 - f.x1) * (l.x1 - f.x1)), f.vec_id,
         struct_pack(d := CAST(NULL AS DOUBLE), v := CAST(NULL AS BIGINT), w := CAST(NULL AS BIGINT),
                     x0 := CAST(NULL AS DOUBLE), x1 := CAST(NULL AS DOUBLE))
  FROM learn l, (SELECT * FROM learn ORDER BY vec_id LIMIT 1) f
  UNION ALL
  SELECT it + 1, vec_id, x0, x1, done OR vec_id = t.v,
         least(best, sqrt((x0 - t.x0) * (x0 - t.x0) + (x1 - t.x1) * (x1 - t.x1))),
         CASE WHEN sqrt((x0 - t.x0) * (x0 - t.x0) + (x1 - t.x1) * (x1 - t.x1)) < best THEN t.v ELSE via END, t
  FROM (SELECT *, min(CASE WHEN NOT done THEN struct_pack(d := best, v := vec_id, w := via, x0 := x0, x1 := x1) END)
               OVER () AS t FROM grown) WHERE t IS NOT NULL),
edges AS (SELECT DISTINCT taken.d AS d, taken.v AS a, taken.w AS b FROM grown WHERE it > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY d, least(a, b), greatest(a, b)) AS step FROM edges)"""

_SINGLE = _PRIM + """,
kept AS (SELECT a, b FROM ranked WHERE step < (SELECT max(step) FROM ranked)),
both_ways AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach(u, m) AS (SELECT vec_id, vec_id FROM learn UNION
                SELECT w.b, r.m FROM reach r JOIN both_ways w ON w.a = r.u WHERE w.b > r.m)
SELECT u AS vec_id, CAST(dense_rank() OVER (ORDER BY min(m)) - 1 AS INTEGER) AS cluster FROM reach GROUP BY u"""

# one merge a step, the least by ward distance and ends
_WARD = f"""WITH RECURSIVE learn AS {S.LEARN},
part(it, vec_id, cid, x0, x1, h, left_over) AS (
  SELECT 0, vec_id, vec_id, x0, x1, CAST(NULL AS DOUBLE), (SELECT count(*) FROM learn) FROM learn
  UNION ALL
  SELECT p.it + 1, p.vec_id, CASE WHEN p.cid = m.s.b THEN m.s.a ELSE p.cid END, p.x0, p.x1, m.s.d, p.left_over - 1
  FROM part p, (
    SELECT min(struct_pack(d := sqrt(2.0 * a.n * b.n / (a.n + b.n) * ((a.x0 - b.x0) * (a.x0 - b.x0)
                                     + (a.x1 - b.x1) * (a.x1 - b.x1))), a := a.cid, b := b.cid)) AS s
    FROM (SELECT cid, count(*) AS n, avg(x0) AS x0, avg(x1) AS x1 FROM part GROUP BY cid) a
    JOIN (SELECT cid, count(*) AS n, avg(x0) AS x0, avg(x1) AS x1 FROM part GROUP BY cid) b ON a.cid < b.cid) m
  WHERE p.left_over > {{left}})"""


def _hier(linkage):
    def run(spark, sf):
        r = hc.hierarchical(tb.f_learn(spark, sf), ["x0", "x1"], 2, linkage, "vec_id")
        return r.labels
    return run


_HIER_SQL = {"single": _SINGLE, "ward": _WARD.format(left=2) + """
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY cid) - 1 AS INTEGER) AS cluster FROM part WHERE left_over = 2"""}
for _l in hc.LINKAGES:
    query(f"hierarchical_{_l}", _HIER_SQL.get(_l))(_hier(_l))


def _lowest(linkage, n=20):
    def run(spark, sf):
        r = hc.hierarchical(tb.f_learn(spark, sf), ["x0", "x1"], 2, linkage, "vec_id")
        return rounded(r.merges.where(F.col("step") <= n))
    return run


query("merge_distances", _WARD.format(left=1) + """
SELECT CAST(step AS INTEGER) AS step, round(h, 6) AS height FROM (
  SELECT h, row_number() OVER (ORDER BY h) AS step FROM (SELECT DISTINCT it, h FROM part WHERE it > 0))
WHERE step <= 20""")(_lowest("ward"))

query("merge_distances_single", _PRIM + """
SELECT CAST(step AS INTEGER) AS step, round(d, 6) AS height FROM ranked WHERE step <= 20""")(_lowest("single"))


# ---- t-SNE (K11, K12) ----------------------------------------------------------------
from ..operators import tsne as ts  # noqa: E402

TSNE_STEPS = 30   # tsne_embed: first 30 steps of the default schedule


# 16 neighbours; the precision of each row by the same bisection, an iteration a step
_AFFINITIES = f"""WITH RECURSIVE learn AS {S.LEARN},
pr AS (SELECT a.vec_id AS q, b.vec_id AS r, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS dd
       FROM learn a JOIN learn b ON a.vec_id <> b.vec_id),
nb AS (SELECT q, r, dd * dd - min(dd * dd) OVER (PARTITION BY q) AS e FROM (
         SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dd, 9), r) AS rk FROM pr) WHERE rk <= 16),
it(step, q, lo, hi, beta, far) AS (
  SELECT 0, q, 0.0::DOUBLE, CAST(NULL AS DOUBLE), 1.0::DOUBLE, true FROM (SELECT DISTINCT q FROM nb)
  UNION ALL
  SELECT step + 1, q, CASE WHEN h > t THEN beta ELSE lo END, CASE WHEN h > t THEN hi ELSE beta END,
         CASE WHEN abs(h - t) < 1e-5 THEN beta WHEN h <= t THEN (beta + lo) / 2 WHEN hi IS NULL THEN beta * 2
              ELSE (beta + hi) / 2 END, abs(h - t) >= 1e-5
  FROM (SELECT step, it.q, lo, hi, beta, ln(5.0::DOUBLE) AS t, ln(sum(exp(-e * beta)))
               + beta * sum(e * exp(-e * beta)) / sum(exp(-e * beta)) AS h
        FROM it JOIN nb ON nb.q = it.q WHERE far AND step < 100 GROUP BY step, it.q, lo, hi, beta)),
fin AS (SELECT q, arg_max(beta, step) AS beta FROM it GROUP BY q),
co AS (SELECT q, r, exp(-e * beta) / sum(exp(-e * beta)) OVER (PARTITION BY q) AS pc FROM nb JOIN fin USING (q))
SELECT i, j, round(sum(pc) / (2.0 * (SELECT count(*) FROM learn)), 9) AS p
FROM (SELECT q AS i, r AS j, pc FROM co UNION ALL SELECT r, q, pc FROM co) GROUP BY i, j"""


@query("tsne_affinities", _AFFINITIES)
def tsne_affinities(spark, sf):
    return rounded(ts.affinities(tb.f_learn(spark, sf), ["x0", "x1"], 5.0, "vec_id"), 9)


@query("tsne_embed")
def tsne_embed(spark, sf):
    emb, _ = ts.embed(tb.f_learn(spark, sf), ["x0", "x1"], 2, 5.0, 200.0, TSNE_STEPS, "vec_id")
    return rounded(emb, 4)


@query("tsne_kl")
def tsne_kl(spark, sf):
    """All steps of the default schedule."""
    steps = 1000
    _, kl = ts.embed(tb.f_learn(spark, sf), ["x0", "x1"], 2, 5.0, 200.0, steps, "vec_id")
    return spark.createDataFrame([(steps, float(kl))], "steps int, kl double")


# ---- all 64 dimensions: moments and components ---------------------------------------
from ..functions.linalg import moments  # noqa: E402
from ..operators import pca as wide_pca  # noqa: E402

_COV = f"""WITH e AS {S.EMB}"""


@query("covariance_64", _COV + """
SELECT a.pos AS i, b.pos AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id
WHERE a.pos <= b.pos GROUP BY a.pos, b.pos""")
def covariance_64(spark, sf):
    m = moments(tb.f_emb(spark, sf), tb.emb_features())
    rows = [(i, j, float(m.cov[i, j])) for i in range(64) for j in range(i, 64)]
    return rounded(spark.createDataFrame(rows, "i int, j int, cov double"))


@query("pca_variance_64", _COV + """,
c AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS v FROM e a JOIN e b ON a.vec_id = b.vec_id
      GROUP BY a.pos, b.pos)
SELECT CAST(64 AS BIGINT) AS components, round(sum(CASE WHEN i = j THEN v END), 6) AS total,
       round(sum(v * v), 6) AS squares FROM c""")
def pca_variance_64(spark, sf):
    """The eigenvalues of all 64 dimensions by their sum and the sum of their squares (trace and norm in SQL)."""
    v = wide_pca.fit(tb.f_emb(spark, sf), tb.emb_features(), 64).variance(spark)
    return rounded(v.agg(F.count(F.lit(1)).alias("components"), F.sum("eigenvalue").alias("total"),
                         F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares")))
