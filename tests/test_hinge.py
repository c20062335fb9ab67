"""Support vector machines: duality gaps, many problems at once against one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.operators import hinge, search, svm


def rows(n=160, p=3):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, p)) * [1.0, 30.0, 0.1][:p]
    return x, np.where(x[:, 0] + x[:, 1] / 40 + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)


def objective(w, b, x, y, C):
    return 0.5 * w @ w + C * np.maximum(0, 1 - y * (x @ w + b)).sum()


@pytest.mark.parametrize("tasks", [1, 20])
def test_problems_in_the_same_passes(spark, tasks):
    """Objectives are those of the rows, gaps are closed, and no nearby plane is better; a problem may have no row."""
    x, y = rows()
    labels = np.stack([y, y, np.where(np.arange(len(y)) % 3 == 0, 0, y), 0 * y], axis=1)
    C = [1.0, 0.01, 20.0, 1.0]
    data = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, labels)],
                                 "phi array<double>, y array<double>").repartition(tasks)
    planes = hinge.solve(data, C, 3, tasks)
    rng = np.random.default_rng(1)
    for i, plane in enumerate(planes[:3]):
        at = labels[:, i] != 0
        value = objective(plane.w, plane.b, x[at], y[at], C[i])
        assert plane.objective == pytest.approx(value) and abs(plane.gap) <= 1e-8 * (1 + value)
        for size in (1e-3, 1e-2, 0.1):
            for _ in range(50):
                dw, db = rng.normal(size=3) * size * [1, 1 / 30, 10], rng.normal() * size
                assert objective(plane.w + dw, plane.b + db, x[at], y[at], C[i]) >= value - 1e-7 * value
    assert planes[3].w.tolist() == [0, 0, 0]


def test_missing_feature_is_an_error(spark):
    data = spark.createDataFrame([([1.0], [1.0]), ([float("nan")], [-1.0])], "phi array<double>, y array<double>")
    with pytest.raises(ValueError, match="1 rows"):
        hinge.solve(data, [1.0], 1, 1)


def test_grid_is_that_of_single_fits(spark):
    x, y = rows(90, 2)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int")
    folds = search.stratified_folds(df, "y", 2, "id").persist()
    cands = [{"C": 1.0, "kernel": "linear"}, {"C": 5.0, "kernel": "poly", "degree": 2}]
    got = search._fold_scores(folds, ["a", "b"], "y", "id", "svm", cands, 2, "accuracy")
    for (c, f), score in got.items():
        one = svm.fit(folds.where(F.col("fold") != f), ["a", "b"], "y", id="id", **cands[c])
        pred = one.predict(folds.where(F.col("fold") == f), "id", keep=["y"])
        assert score == pytest.approx(pred.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0])


def test_tasks_send_one_sum(spark, monkeypatch):
    """The driver gets the upper half of the matrices once, however many tasks there are; it got 16 whole ones."""
    x, y = rows(400, 3)
    data = spark.createDataFrame([(a.tolist(), [float(b)]) for a, b in zip(x, y)],
                                 "phi array<double>, y array<double>").repartition(12)
    sent, collect = [], type(data).collect

    def told(self):
        got = collect(self)
        sent.append(sum(len(r["s"]) for r in got if isinstance(r["s"], (bytes, bytearray))))
        return got
    monkeypatch.setattr(type(data), "collect", told)
    sums = hinge._sums(data, np.array([1.0]), np.array([0]), [], 3, 12)
    assert sent == [8 * (4 * 5 // 2 + 3 * 4 + 5)]
    z = np.hstack([x, np.ones((len(x), 1))])
    assert sums[0, :16].reshape(4, 4) == pytest.approx(z.T @ z / (4 + 2))


def test_passes_run_in_many_tasks(spark, monkeypatch):
    """Rows from one file were one task, whatever their number."""
    x, y = rows(90, 2)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int").coalesce(1)
    seen, solve = [], hinge.solve
    monkeypatch.setattr(svm, "TASK_WORK", 20)
    monkeypatch.setattr(hinge, "solve", lambda data, *a, **k: seen.append(data.rdd.getNumPartitions()) or solve(
        data, *a, **k))
    svm.fit(df, ["a", "b"], "y", kernel="linear")
    assert seen == [5]


def test_folds_of_a_linear_svm_share_their_passes(spark, monkeypatch):
    from tablelearn.operators import hinge, svm
    rng = np.random.default_rng(5)
    rows = [(i, *(rng.standard_normal(2) + [i % 2, 0]).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    asked, one = [], hinge.solve
    monkeypatch.setattr(hinge, "solve", lambda data, C, *a, **k: asked.append(len(C)) or one(data, C, *a, **k))
    svm.fit(df, ["x", "y"], "label", kernel="linear", probability=True)
    assert asked == [1, 5]


def test_a_pass_computes_only_the_problems_of_a_row(spark, monkeypatch):
    """Records hold the rows that are in the same problems; steps saved with the rows need no replay."""
    x, y = rows(300, 2)
    part = np.arange(len(y)) % 3
    labels = np.stack([np.where(part == k, 0, y) for k in range(3)], axis=1)
    data = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, labels)],
                                 "phi array<double>, y array<double>").coalesce(1)
    held = data.mapInArrow(hinge._pack, hinge.RECORD).collect()
    assert sorted(tuple(np.frombuffer(r["cols"], np.int32)) for r in held) == [(0, 1), (0, 2), (1, 2)]
    assert sum(len(r["x"]) for r in held) == 300 * 2 * 8
    one = hinge.solve(data, [1.0, 2.0, 3.0], 2, 1)
    replayed, move = [], hinge._of
    monkeypatch.setattr(hinge, "_of", lambda steps, at: replayed.append(len(steps)) or move(steps, at))
    monkeypatch.setattr(hinge, "SAVE", 3)
    many = hinge.solve(data.repartition(4), [1.0, 2.0, 3.0], 2, 4)
    assert max(replayed) == 3 and len(replayed) > 10
    for a, b in zip(one, many):
        assert a.w == pytest.approx(b.w, abs=1e-6) and a.objective == pytest.approx(b.objective)


def test_wide_rows_are_made_in_the_passes(spark, monkeypatch):
    """Each pass moved all rows at the width of the kernel's map."""
    x, y = rows(60, 2)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int")
    seen, solve = [], hinge.solve
    monkeypatch.setattr(hinge, "solve", lambda data, C, width, *a, **k: seen.append(
        (data.select(F.max(F.size("_phi"))).first()[0], width)) or solve(data, C, width, *a, **k))
    for kernel, width in (("rbf", 20), ("sigmoid", None)):
        model = svm.fit(df, ["a", "b"], "y", kernel=kernel, n_components=20)
        assert seen[-1] == (2, width or len(model.pairs[0][2]))
        z = model.fmap.kernel_map()(x)
        w, b = model.pairs[0][2:]
        out = np.array([r.margin for r in model.predict(df).orderBy("id").collect()])
        assert out == pytest.approx(z @ w + b) and abs(model.gaps[0]) < 1e-6 * (1 + objective(w, b, z, y, 1.0))
