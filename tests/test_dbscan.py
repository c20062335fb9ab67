"""DBSCAN over cells against its definition."""

import numpy as np
import pytest

from tablelearn.functions import cells
from tablelearn.operators import dbscan

from conftest import frame


def plain(X, eps, least):
    """(cluster, is_core) of each row."""
    near = ((X[:, None] - X[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label, number = np.full(len(X), -1), 0
    for i in range(len(X)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = number
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return [(int(c), bool(k)) for c, k in zip(label, core)]


def data(kind, rng):
    if kind == "dense":              # half of the rows in one cube, some in the next ones
        X = rng.normal(size=(400, 2)) * 2
        X[:200] = rng.random((200, 2)) * 0.01
        X[200:240] = rng.random((40, 2)) * 0.05 + (0.3, 0.0)
        return X, 0.35
    if kind == "lattice":            # many pairs at eps exactly
        return rng.integers(0, 25, (300, 2)) * 0.5, 0.5
    if kind == "equal":
        return np.repeat(rng.normal(size=(40, 3)), 6, axis=0), 0.6
    return np.sort(rng.random((300, 1)), axis=0) * 50, 0.15


@pytest.mark.parametrize("kind,rows", [("dense", 15), ("lattice", 25), ("equal", 40), ("line", 1024)])
def test_against_definition(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(cells, "CELL_ROWS", rows)
    X, eps = data(kind, np.random.default_rng(8))
    df = frame(spark, [(i, *map(float, x)) for i, x in enumerate(X)],
               "id long, " + ", ".join(f"x{j} double" for j in range(X.shape[1])))
    got = {r.id: (r.cluster, r.is_core) for r in dbscan.dbscan(df, [f"x{j}" for j in range(X.shape[1])], eps, 5)
           .collect()}
    assert [got[i] for i in range(len(X))] == plain(X, eps, 5)


def test_dense_cube_is_not_compared_with_itself(spark, monkeypatch):
    """Rows compared across cells grow with a cube's rows, not with their square."""
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    reach, sent = cells.reach, []
    monkeypatch.setattr(cells, "reach", lambda *a: sent.append(reach(*a)) or sent[-1])
    for n in (400, 1600):
        rng = np.random.default_rng(9)
        X = np.concatenate([rng.random((n, 2)) * 0.3, rng.random((n, 2)) * 100])
        df = frame(spark, [(i, *map(float, x)) for i, x in enumerate(X)], "id long, x0 double, x1 double")
        assert dbscan.dbscan(df, ["x0", "x1"], 0.5, 5).where("is_core").count() >= n
        assert sum(len(r.p) for d in sent for r in d.collect()) <= 4 * n
        sent.clear()


def test_odd_tables(spark):
    empty = frame(spark, [], "id long, x0 double")
    assert dbscan.dbscan(empty, ["x0"], 1.0, 2).count() == 0
    one = frame(spark, [("a", 1.0)], "k string, x0 double")
    assert [tuple(r) for r in dbscan.dbscan(one, ["x0"], 1.0, 1, "k").collect()] == [("a", 0, True)]
    assert [tuple(r) for r in dbscan.dbscan(one, ["x0"], 1.0, 2, "k").collect()] == [("a", -1, False)]
    for bad in (dict(eps=0), dict(min_samples=0)):
        with pytest.raises(ValueError):
            dbscan.dbscan(one, ["x0"], **{"eps": 1.0, "min_samples": 2, "id": "k"} | bad)
