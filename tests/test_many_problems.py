"""Many (candidate, size, fold) problems in one pass, against one model at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.operators import metrics, neighbors, search


def table(spark, n=240, places=None):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 2)).round(3)
    if places:
        x[: n // 3] = 0.5                     # a third of all rows in one place
    y = (x[:, 0] + rng.normal(size=n) * 0.7 > 0).astype(int) + (x[:, 1] > 1)
    return x, y, spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))],
                                       "id long, a double, b double, y int")


@pytest.mark.parametrize("block_rows", [None, 30])
def test_neighbours_of_all_problems(spark, block_rows):
    """Every list of neighbours by brute force, with and without cells, equal places included."""
    x, y, df = table(spark, places=True)
    n, cv, sizes, k = len(x), 3, [4, 40, 160], 5
    fold = np.arange(n) % cv
    at = np.array([[-1 if fold[i] == f else int((fold[:i] != f).sum()) for f in range(cv)] for i in range(n)])
    placed = df.join(spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(at)], "id long, at array<long>"), "id")
    out = neighbors.knn_problems(placed, ["a", "b"], "y", k, sizes, cv, "at", train=True, block_rows=block_rows)
    got = {}
    for r in out.collect():
        got.setdefault((r.q, r.part, r["size"]), {})[r.rank] = (r.r, r.lab)
        assert r.y == y[r.q] and r.seen == (at[r.q, r.part] >= 0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    asked = 0
    for f in range(cv):
        for s, size in enumerate(sizes):
            refs = np.flatnonzero((at[:, f] >= 0) & (at[:, f] < size))
            for q in np.flatnonzero(at[:, f] < size):
                want = refs[np.lexsort((refs, d[q, refs]))][:k]
                assert got[q, f, s] == {i + 1: (r, y[r]) for i, r in enumerate(want)}
                asked += 1
    assert asked == len(got)


GRIDS = {"knn": {"n_neighbors": [1, 4], "weights": ["uniform", "distance"], "p": [1, 2]},
         "nb": {"model_type": ["gaussian", "bernoulli"], "alpha": [1.0]}}


@pytest.mark.parametrize("model", ["knn", "nb"])
def test_scores_are_those_of_single_models(spark, model):
    _, _, df = table(spark, 120)
    folds = search.stratified_folds(df, "y", 3, "id").persist()
    cands = search.candidates(GRIDS[model])
    for scoring in ("accuracy", "f1_macro", "precision_weighted", "neg_mean_squared_error"):
        got = search._fold_scores(folds, ["a", "b"], "y", "id", model, cands, 3, scoring)
        assert len(got) == 3 * len(cands)
        for c, f in [(0, 0), (len(cands) - 1, 2)]:
            one = search._fold_score(search.get_model(model), folds, f, ["a", "b"], "y", "id", scoring, cands[c])
            assert got[c, f] == pytest.approx(one, abs=1e-12)


def test_learning_curve_of_naive_bayes(spark):
    """The shared moments give the curve that one fit a (size, fold) gives."""
    _, _, df = table(spark, 150)
    shared = search.learning_curve(df, ["a", "b"], "y", "nb", 3, (0.2, 0.6, 1.0), "id").collect()
    kept = dict(search.SHARED)
    try:
        search.SHARED.clear()
        single = search.learning_curve(df, ["a", "b"], "y", "nb", 3, (0.2, 0.6, 1.0), "id").collect()
    finally:
        search.SHARED.update(kept)
    assert [tuple(r) for r in shared] == [pytest.approx(tuple(r)) for r in single]


def test_scores_by_key(spark):
    pred = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 2, 2), (1, 1, 2), (1, 3, 3)], "k int, label int, prediction int")
    for s in ("accuracy", "recall_macro", "f1_weighted", "r2", "neg_mean_absolute_error"):
        both = {r.k: r.score for r in metrics.score(pred, s, keys=["k"]).collect()}
        assert both == {k: pytest.approx(metrics.score(pred.where(F.col("k") == k), s).first().score) for k in (0, 1)}
    with pytest.raises(ValueError, match="roc_auc"):
        metrics.score(pred, "roc_auc", keys=["k"])
