"""Cases that once gave wrong answers: perfect features, null classes, overflow,
unknown parameters, wide and far data, hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.functions.distance import minkowski
from tablelearn.functions.quantile import exact_quantiles
from tablelearn.functions.rank import global_rank
from tablelearn.operators import bayes, knn, metrics, roc, search, select, silhouette, split, svm


def test_perfect_features_rank_first(spark):
    rows = [(i, float(i % 2), float((i * 7) % 5), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, perfect double, noise double, label int")
    scores = {r.feature: r.score for r in select.f_classif(df, ["perfect", "noise"], "label").collect()}
    assert scores["perfect"] == float("inf") and scores["noise"] < 10
    ranked, data = select.select_k_best(df, ["noise", "perfect"], "label", k=1)
    assert data.columns == ["id", "perfect"]
    line = df.select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2).alias("y"))
    assert select.f_regression(line, ["x"], "y").first()["score"] > 1e12
    flat = df.withColumn("flat", F.lit(1.0))
    assert select.f_classif(flat, ["flat"], "label").first()["score"] is None


def test_null_classes_stay(spark):
    rows = [(i, None if i % 5 == 0 else ("a" if i % 2 else "b")) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = split.train_test_split(df, "id", 0.2, stratify="label")
    assert out.count() == 100 and out.where("split = 'test'").count() == 20
    assert out.where("label is null and split = 'test'").count() == 4
    folds = split.stratified_folds(df, "label", 5, "id")
    assert folds.count() == 100
    assert {r["count"] for r in folds.groupBy("fold").count().collect()} == {20}


def test_quotas_of_huge_tables(spark):
    sizes = {"a": 3 * 10**18, "b": 10**18 + 1}
    counts = spark.createDataFrame(list(sizes.items()), "label string, n long")
    total, draws = sum(sizes.values()), 3 * 10**18
    want = {c: n * draws // total for c, n in sizes.items()}
    want[max(sizes, key=lambda c: sizes[c] * draws % total)] += draws - sum(want.values())
    got = {r.label: r.q for r in split._approx_mode(counts, total, draws, "n", "q", "label").collect()}
    assert got == want


def test_auc_of_huge_counts(spark, monkeypatch):
    big = 5_000_000_000
    grouped = spark.createDataFrame([(0.9, big, 0), (0.1, 0, big)], "threshold double, pos long, neg long")
    monkeypatch.setattr(roc, "_grouped", lambda *a: grouped)
    assert roc.auc(grouped).first()["auc"] == 1.0


def test_unknown_parameters_are_errors(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(30)], "id long, x double, label int")
    with pytest.raises(ValueError, match="bogus"):
        search.grid_search(df, ["x"], "label", {"bogus": [1, 2]}, "knn", cv=2)
    with pytest.raises(ValueError, match="max_dept"):
        search.cross_validate(df, ["x"], "label", "tree", cv=2, params={"max_dept": 3})


def clusters(spark, n=90, k=3):
    rng = np.random.default_rng(1)
    rows = [(i, *(rng.standard_normal(2) * 0.3 + [3 * (i % k), i % k]).tolist(), i % k) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, label int")


def test_best_candidate_is_refit(spark):
    df = clusters(spark)
    grid = {"n_neighbors": [1, 3], "weights": ["uniform", "distance"]}
    results = search.grid_search(df, ["x", "y"], "label", grid, "knn", cv=3)
    assert search.best_params(results, grid) in search.candidates(grid)
    pred = search.fit_best(df, ["x", "y"], "label", results, grid, "knn")(df, proba=True)
    assert pred.count() == 90 and {"p_0", "p_1", "p_2"} <= set(pred.columns)
    assert metrics.accuracy(pred, "label").first()["accuracy"] > 0.95


@pytest.mark.parametrize("model", ("logistic", "knn", "nb"))
def test_evaluation_by_model_name(spark, model):
    df = clusters(spark, k=2)
    pred = search.predict_split(df, ["x", "y"], "label", model, proba=True)
    assert pred.count() == 18
    assert metrics.score(pred, "roc_auc").first()["score"] == 1.0
    curve = roc.curve_points(pred, "label", "p_1", 1)
    assert curve.agg(F.max("tpr")).first()[0] == 1.0
    assert metrics.classification_report(pred, "label").count() == 2


def test_svm_probabilities_of_three_classes(spark):
    df = clusters(spark)
    model = svm.fit(df, ["x", "y"], "label", kernel="linear", probability=True, max_iter=5)
    out = model.predict(df, "id", ["label"]).collect()
    assert all(abs(r.p_0 + r.p_1 + r.p_2 - 1) < 1e-9 for r in out)
    assert sum(max((0, 1, 2), key=lambda c: r[f"p_{c}"]) == r.label for r in out) > 80
    counts = {r["class"]: r.n_support for r in svm.support_counts(model, df, "label").collect()}
    assert counts and set(counts) <= {0, 1, 2} and all(0 < n <= 30 for n in counts.values())


def far_rows(n=120, p=12):
    rng = np.random.default_rng(2)
    return 1e6 + 0.01 * rng.standard_normal((n, p))


def test_distances_far_from_the_origin(spark):
    x = far_rows()
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(minkowski(x, x), true, rtol=1e-12)
    assert np.allclose(minkowski(x, x, 1.0), np.abs(x[:, None] - x[None]).sum(2))
    assert np.allclose(minkowski(x, x, 3.0), (np.abs(x[:, None] - x[None]) ** 3).sum(2) ** (1 / 3))
    assert np.allclose(minkowski(x, x, float("inf")), np.abs(x[:, None] - x[None]).max(2))
    names = [f"f{j}" for j in range(12)]
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)],
                               "id long, " + ", ".join(f"{c} double" for c in names))
    got = {}
    for r in knn.knn(df, df, names, 5, block_rows=50).collect():
        got.setdefault(r.q, []).append((r["rank"], r.r))
    for i in range(len(x)):
        near = np.lexsort((np.arange(len(x)), np.round(true[i], 9)))[:5]
        assert [r for _, r in sorted(got[i])] == near.tolist()
    lab = df.withColumn("cluster", (F.col("f0") > 1e6).cast("int"))
    one = {r.id: r.silhouette for r in silhouette.silhouette_samples(lab, names, block_rows=4096).collect()}
    many = {r.id: r.silhouette for r in silhouette.silhouette_samples(lab, names, block_rows=40).collect()}
    assert all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_naive_bayes_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = 1e7 + rng.standard_normal((60, 130))
    names = [f"f{j}" for j in range(130)]
    rows = [(i, *(v + 0.4 * (i % 2)).tolist(), i % 2) for i, v in enumerate(x)] + [(99, None, *x[0, 1:].tolist(), 0)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names) + ", label int")
    model = bayes.fit(df, names, "label")
    wide = {r.id: r.prediction for r in model.predict(df, "id", proba=False).collect()}
    monkeypatch.setattr(bayes, "WIDE_TERMS", 10**6)
    narrow = {r.id: r.prediction for r in model.predict(df, "id", proba=False).collect()}
    assert wide == narrow and wide[99] is None


def test_hot_values_are_spread(spark):
    n = 4000
    df = spark.range(n).select("id", F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    ranked = global_rank(df, [F.col("v"), F.col("id")], "r", sums={"s": F.col("id")}, buckets=16)
    rows = ranked.orderBy("r").collect()
    want = sorted(((r.v, r.id) for r in df.collect()))
    assert [(r.v, r.id) for r in rows] == want and [r.r for r in rows] == list(range(n))
    assert [r.s for r in rows] == np.cumsum([i for _, i in want]).tolist()
    values = np.array([v for v, _ in want])
    assert exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.95, 1.0])[0] == np.quantile(
        values, [0.0, 0.25, 0.5, 0.95, 1.0]).tolist()


def test_ranking_of_few_rows(spark):
    empty = spark.createDataFrame([], "id long")
    assert global_rank(empty, [F.col("id")], "r").count() == 0
    one = spark.createDataFrame([(None,), (3,)], "id long")
    assert [r.r for r in global_rank(one, [F.col("id")], "r").orderBy("r").collect()] == [0, 1]


def brute_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(c):
        mean = {v: d[i, c == v].sum() / ((c == v).sum() - (v == own)) for v in set(c.tolist()) if (c == v).sum() - (v == own)}
        a, b = mean.get(own), min(m for v, m in mean.items() if v != own)
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("kinds", [3, 90])         # clusters summed by a product, and one by one
def test_silhouette_by_tiles(spark, monkeypatch, kinds):
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(150, 2)), np.concatenate([np.arange(kinds), rng.integers(0, kinds, 150 - kinds)])
    df = spark.createDataFrame([(i, *v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))],
                               "id long, x double, y double, cluster int")
    for name, value in (("TILE_ROWS", 7), ("TILE_COLS", 11)):
        monkeypatch.setattr(silhouette, name, value)
    got = {r.id: r.silhouette for r in silhouette.silhouette_samples(df, ["x", "y"], block_rows=32).collect()}
    assert np.allclose([got[i] for i in range(150)], brute_silhouette(x, c), atol=1e-9)


def test_silhouette_analysis_measures_distances_once(spark, monkeypatch):
    asked = []
    one = silhouette._distance_sums
    monkeypatch.setattr(silhouette, "_distance_sums", lambda *a: asked.append(a) or one(*a))
    df = clusters(spark, k=3)
    out = {r.k: r for r in silhouette.silhouette_analysis(df, ["x", "y"], "id", 2, 4, n_init=1).collect()}
    assert len(asked) == 1 and sorted(out) == [2, 3, 4] and out[3].best
    from tablelearn.operators import kmeans
    for k, r in out.items():
        m = kmeans.kmeans(df, ["x", "y"], k, "id", n_init=1, seed=42)
        alone = silhouette.silhouette_score(m.assign(df, "id", ["x", "y"]), ["x", "y"], "cluster", "id").first()
        assert r.silhouette == pytest.approx(alone.silhouette, abs=1e-12)


def test_silhouette_pairs_leave_few_rows(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "cast(id as double) x", "cast(id % 2 as int) cluster")
    made = []
    one = silhouette._distance_sums
    monkeypatch.setattr(silhouette, "_distance_sums", lambda *a: made.append(one(*a)) or made[0])
    silhouette.silhouette_samples(df, ["x"], block_rows=4).count()
    assert made[0].count() == 400 * 8 * 2             # points x blocks x clusters, not x tiles of block_rows
