"""Models, splits, metrics and clustering vs goldens, brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.functions import rank as rk
from tablelearn.functions import linalg
from tablelearn.operators import (bayes, dbscan, hierarchy, kmeans, knn, linear, logistic,
                                  metrics, pca, roc, search, silhouette, split, tree)

from conftest import SF01, frame


def xy_frame(spark, X, y=None, ytype="int"):
    rows = [(i, *map(float, x)) + ((int(y[i]) if ytype == "int" else float(y[i]),)
                                   if y is not None else ()) for i, x in enumerate(X)]
    cols = ", ".join(f"x{j} double" for j in range(len(X[0])))
    return frame(spark, rows, f"id long, {cols}" + (f", y {ytype}" if y is not None else ""))


def test_logistic_golden(spark):
    X = [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]]
    df = xy_frame(spark, X, [0, 0, 1, 1, 0, 1])
    m = logistic.fit(df, ["x0", "x1"], "y", C=1.0)
    assert m.coef[0] == pytest.approx([0.1610, 0.1610], abs=1e-3)
    assert m.intercept[0] == pytest.approx(-2.0926, abs=1e-3)
    acc = metrics.accuracy(m.predict(df, "id", keep=["y"]), "y").first().accuracy
    assert acc == pytest.approx(4 / 6)


def test_pca_golden(spark):
    X = [[2.5, 2.4, 2.1], [0.5, 0.7, 4.2], [2.2, 2.9, 1.5], [1.9, 2.2, 3.3], [3.1, 3.0, 2.7]]
    m = pca.fit(xy_frame(spark, X), ["x0", "x1", "x2"], 3)
    assert m.eigenvalues == pytest.approx([2.5388, 0.3174, 0.0327], abs=1e-4)
    assert m.ratio == pytest.approx([0.8788, 0.1099, 0.0113], abs=1e-4)
    assert np.abs(m.components[0]) == pytest.approx([0.5655, 0.5678, 0.5982], abs=1e-4)
    assert m.components @ m.components.T == pytest.approx(np.eye(3), abs=1e-9)


def test_kmeans_golden_and_silhouette(spark):
    X = [[1, 2], [1.5, 1.8], [5, 8], [8, 8], [1, 0.6], [9, 11]]
    df = xy_frame(spark, X)
    m = kmeans.kmeans(df, ["x0", "x1"], 2, init_centers=[[1, 2], [5, 8]])
    lab = {r.id: r.cluster for r in m.assign(df).collect()}
    assert {i for i in lab if lab[i] == lab[0]} == {0, 1, 4}
    assert m.inertia == pytest.approx(15.98, abs=1e-2)
    a = m.assign(df, keep=["x0", "x1"])
    s = silhouette.silhouette_score(a, ["x0", "x1"], "cluster").first().silhouette
    assert s == pytest.approx(0.7480, abs=1e-4)
    # blocked layout gives the same answer with many tiny blocks
    s2 = silhouette.silhouette_score(a, ["x0", "x1"], "cluster", block_rows=2).first()
    assert s2.silhouette == pytest.approx(s, abs=1e-12)


def test_linear_singular_min_norm(spark):
    df = xy_frame(spark, [[1, 2], [3, 4], [5, 6]], [10, 20, 30], "double")
    m = linear.linear_regression(df, ["x0", "x1"], "y")
    assert m.coef == pytest.approx([2.5, 2.5])      # minimum-norm split of slope 5
    pred = m.predict(df, "id", keep=["y"])
    r = metrics.regression_metrics(pred, "y").first()
    assert r.r2 == pytest.approx(1.0) and r.mse == pytest.approx(0, abs=1e-18)


def test_ridge_lasso_closed_form(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3)) * [1, 5, 0.2]
    y = X @ [1.0, -0.5, 3.0] + rng.normal(size=60)
    df = xy_frame(spark, X, y, "double")
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(3), Xc.T @ yc)
    assert linear.ridge_regression(df, ["x0", "x1", "x2"], "y", 2.0).coef == pytest.approx(w)
    m = linear.lasso_regression(df, ["x0", "x1", "x2"], "y", alpha=0.3)
    # KKT: |grad_j| <= alpha where w_j = 0, = alpha * sign(w_j) elsewhere
    g = Xc.T @ (yc - Xc @ m.coef) / len(y)
    for gj, wj in zip(g, m.coef):
        if wj == 0:
            assert abs(gj) <= 0.3 + 1e-9
        else:
            assert gj == pytest.approx(0.3 * np.sign(wj), abs=1e-8)


def test_split_exact_sizes_and_strata(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 3).alias("y"))
    s = split.train_test_split(df, "id", 0.2, 7)
    assert s.where("split = 'test'").count() == math.ceil(0.2 * 103)
    st = split.train_test_split(df, "id", 0.2, 7, stratify="y")
    d = {r.y: (r.n_train, r.n_test) for r in split.split_class_distribution(st, "y").collect()}
    assert sum(v[1] for v in d.values()) == 21
    assert max(v[1] for v in d.values()) - min(v[1] for v in d.values()) <= 1


def test_global_rank_matches_plain_order(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("k"))
    r = rk.global_rank(df, [F.col("k"), F.col("id")], "r", sums={"c": F.col("k")})
    got = {x.id: (x.r, x.c) for x in r.collect()}
    rows = sorted((x.k, x.id) for x in df.collect())
    acc = 0
    for i, (k, idx) in enumerate(rows):
        acc += k
        assert got[idx] == (i, acc)


def test_folds_partition_and_spread(spark):
    df = spark.range(57).select("id", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("y"))
    f = split.stratified_folds(df, "y", 5)
    assert f.count() == 57 and f.select("id").distinct().count() == 57
    per = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in per if r.y == y]
        assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):   # the reference README's cv=5 on 2 rows per class
        split.stratified_folds(spark.range(4).select("id", (F.col("id") >= 2).cast("int")
                                                     .alias("y")), "y", 5)


def test_gaussian_nb_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(80, 3)) + np.repeat([[0, 0, 0], [1, 2, 0]], 40, axis=0)
    y = np.repeat([0, 1], 40)
    df = xy_frame(spark, X, y)
    m = bayes.fit(df, ["x0", "x1", "x2"], "y")
    eps = 1e-9 * X.var(axis=0).max()
    jll = []
    for c in (0, 1):
        mu, var = X[y == c].mean(0), X[y == c].var(0) + eps
        jll.append(np.log(0.5) - 0.5 * np.sum(np.log(2 * np.pi * var))
                   - 0.5 * (((X - mu) ** 2) / var).sum(1))
    want = np.argmax(np.array(jll), axis=0)
    got = [r.prediction for r in m.predict(df, "id").orderBy("id").collect()]
    assert got == list(want)


def test_roc_auc_invariants(spark):
    rng = np.random.default_rng(2)
    s = rng.random(200).round(2)
    y = (rng.random(200) < s).astype(int)
    df = frame(spark, [(i, int(y[i]), float(s[i])) for i in range(200)],
               "id long, y int, score double")
    a = roc.auc(df, "y", "score").first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert a == pytest.approx(want)
    rev = roc.auc(df.withColumn("score", -F.col("score")), "y", "score").first().auc
    assert rev == pytest.approx(1 - a)
    cur = roc.curve_points(df, "y", "score").orderBy("point").collect()
    assert all(b.fpr >= a_.fpr and b.tpr >= a_.tpr for a_, b in zip(cur, cur[1:]))


def test_tree_stump_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    X = rng.integers(0, 6, size=(50, 2)).astype(float)
    y = ((X[:, 0] + rng.integers(0, 3, 50)) > 4).astype(int)
    m = tree.fit(xy_frame(spark, X, y), ["x0", "x1"], "y", max_depth=1)
    root = m.nodes.where("node = 0").first()

    def gini_w(lab):
        n = len(lab)
        return 0 if n == 0 else n - sum(np.sum(lab == c) ** 2 for c in (0, 1)) / n
    best = None
    for j in range(2):
        vals = np.unique(X[:, j])
        for a, b in zip(vals, vals[1:]):
            t = (a + b) / 2
            g = gini_w(y) - gini_w(y[X[:, j] <= t]) - gini_w(y[X[:, j] > t])
            key = (-g, j, t)
            if best is None or key < best:
                best = key
    assert (root.feature_pos, root.threshold) == (best[1], best[2])
    assert root.gain == pytest.approx(-best[0])


def test_full_tree_fits_training_data(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 2))
    y = (X[:, 0] * X[:, 1] > 0).astype(int)
    df = xy_frame(spark, X, y)
    m = tree.fit(df, ["x0", "x1"], "y")
    acc = metrics.accuracy(m.predict(df, "id", keep=["y"]), "y").first().accuracy
    assert acc == 1.0
    imp = m.importance().agg(F.sum("importance")).first()[0]
    assert imp == pytest.approx(1.0)


@pytest.mark.parametrize("fan", [12, 2])
def test_running_sums_restart_and_run_across_windows(spark, monkeypatch, fan):
    monkeypatch.setattr(tree, "FAN", fan)
    rng = np.random.default_rng(3)
    rows = [(g, int(c), float(rng.integers(1, 9))) for g in "ab" for c in sorted(rng.choice(70, 40, replace=False))]
    h = spark.createDataFrame(rows, "k string, code long, w double").withColumn("first", F.struct("code"))
    got = {(r.k, r.code): (r.B_w, r.next and r.next.code) for r in tree._running(h, ["k"], ["w"], 70).collect()}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        for i, r in enumerate(mine):
            after = mine[i + 1][1] if i + 1 < len(mine) else None
            assert got[g, r[1]] == (sum(x[2] for x in mine[:i]), after)


def test_wide_moments_are_narrow_ones(spark, monkeypatch):
    """Products of Arrow batches and covar_pop agree, also with nulls and an offset."""
    rng = np.random.default_rng(6)
    rows = [(*[None if rng.random() < 0.1 else float(v) for v in rng.normal(1e6, 1, 3)], 1.0) for _ in range(80)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    narrow = linalg.moments(df, list("abcd"))
    monkeypatch.setattr(linalg, "WIDE", 2)
    wide = linalg.moments(df, list("abcd"))
    assert wide.n == narrow.n and np.allclose(wide.mean, narrow.mean, rtol=1e-12)
    assert np.allclose(wide.cov, narrow.cov, atol=1e-9)
    with pytest.raises(ValueError, match="empty"):
        linalg.moments(df.limit(0), list("abcd"))


def test_tree_with_nulls_and_repeated_rows(spark):
    """A null counts below every value, in fitting and in predicting."""
    rows = [(i, None if i % 4 == 0 else float(i % 4), 0 if i % 4 < 2 else 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    m = tree.fit(df, ["x"], "y")
    assert [r.threshold for r in m.nodes.where("not is_leaf").collect()] == [1.5]
    assert m.predict(df, keep=["y"]).where("prediction <> y").count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(40, 3))
    y = rng.integers(0, 3, 40)
    df = xy_frame(spark, X, y)
    got = {r.id: r.prediction for r in knn.classify(df, df, ["x0", "x1", "x2"], "y", 5,
                                                    id="id").collect()}
    for i in range(40):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        nn = np.lexsort((np.arange(40), d.round(9)))[:5]
        votes = np.bincount(y[nn], minlength=3)
        assert got[i] == int(np.argmax(votes))


def naive_merging(X, linkage, k):
    """Merge the two closest clusters, by definition of the linkage, until one is left."""
    def dist(a, b):
        if linkage == "ward":
            gap = np.linalg.norm(X[a].mean(0) - X[b].mean(0))
            return np.sqrt(2.0 * len(a) * len(b) / (len(a) + len(b))) * gap
        d = np.linalg.norm(X[a][:, None] - X[b][None], axis=2)
        return {"single": d.min, "complete": d.max, "average": d.mean}[linkage]()

    parts, heights, labels = [[i] for i in range(len(X))], [], None
    while len(parts) > 1:
        if len(parts) == k:
            order = sorted(parts, key=min)
            labels = {i: c for c, part in enumerate(order) for i in part}
        h, i, j = min((dist(parts[i], parts[j]), i, j) for j in range(len(parts)) for i in range(j))
        heights.append(h)
        parts[i] = parts[i] + parts.pop(j)
    return heights, labels


def test_hierarchy_matches_sequential_merging(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(25, 2))
    for link in hierarchy.LINKAGES:
        heights, labels = naive_merging(X, link, 3)
        r = hierarchy.hierarchical(xy_frame(spark, X), ["x0", "x1"], 3, link)
        assert {x.id: x.cluster for x in r.labels.collect()} == labels
        assert [x.height for x in r.merges.orderBy("step").collect()] == pytest.approx(sorted(heights))
    with pytest.raises(ValueError, match="max_points"):
        hierarchy.hierarchical(xy_frame(spark, X), ["x0", "x1"], 3, "complete", max_points=10)
    rough = hierarchy.hierarchical(xy_frame(spark, X), ["x0", "x1"], 3, "average", max_points=10, approximate=True)
    assert not rough.exact and rough.labels.count() == 25


def test_dbscan_small(spark):
    X = [[0, 0], [0, 0.1], [0.1, 0], [0.1, 0.1], [5, 5], [5, 5.1], [5.1, 5], [9, 9]]
    lab = {r.id: r.cluster for r in dbscan.dbscan(xy_frame(spark, X), ["x0", "x1"], 0.2, 3)
           .collect()}
    assert [lab[i] for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, -1]


def test_cross_validate_and_grid(spark):
    from tablelearn.sources import tables as tb
    df = tb.f_learn(spark, SF01)
    cv = search.cross_validate(df, ["x0", "x1"], "y", "nb", 3, "accuracy", "vec_id")
    assert cv.count() == 3 and cv.agg(F.min("score")).first()[0] > 0.8
    g = search.grid_search(df, ["x0", "x1"], "y", {"n_neighbors": [1, 5]}, "knn", 3,
                           "accuracy", "vec_id")
    assert g.where("best").count() == 1
