"""Single linkage and ward over many cells against sequential merging."""

import math

import numpy as np
import pytest

from tablelearn.functions import cells
from tablelearn.functions.components import connected_components
from tablelearn.operators import hierarchy

from conftest import frame


def prim(X, p):
    """Ascending edge lengths of a minimum spanning tree."""
    def dist(a):
        diff = np.abs(X - a)
        return diff.max(axis=1) if math.isinf(p) else (diff ** p).sum(axis=1) ** (1 / p)

    best, done, out = dist(X[0]), np.zeros(len(X), bool), []
    done[0] = True
    for _ in range(len(X) - 1):
        i = int(np.argmin(np.where(done, np.inf, best)))
        out.append(best[i])
        done[i] = True
        best = np.minimum(best, dist(X[i]))
    return sorted(out)


def parts_below(X, h, p=2.0):
    """Components of points nearer than or as near as h, as sets of rows."""
    left, out = set(range(len(X))), []
    while left:
        grown, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            grown.add(i)
            near = {j for j in left if np.linalg.norm(X[i] - X[j], ord=p) <= h + 1e-12}
            left -= near
            todo += near
        out.append(frozenset(grown))
    return set(out)


def sets(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(v) for v in out.values()}, out


def points(spark, X):
    return frame(spark, [(i, *map(float, x)) for i, x in enumerate(X)],
                 "id long, " + ", ".join(f"x{j} double" for j in range(X.shape[1])))


def shape(kind, n, rng):
    if kind == "clumps":         # far apart, so that whole cells belong to one component
        return rng.normal(size=(n, 2)) * 0.1 + rng.integers(0, 3, (n, 1)) * [[20.0, 7.0]]
    if kind == "line":
        return np.cumsum(rng.random((n, 1)), axis=0)
    if kind == "repeats":
        return rng.integers(0, 6, (n, 2)).astype(float) + rng.choice([0.0, 0.013], (n, 2))
    return rng.normal(size=(n, 3))


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 16)
    monkeypatch.setattr(hierarchy, "FINISH", 40)
    monkeypatch.setattr(hierarchy, "CONTRACT", 30)


@pytest.mark.parametrize("kind", ["clumps", "repeats"])
def test_single_over_cells(spark, small_cells, kind):
    X = shape(kind, 110, np.random.default_rng(3))
    cols = [f"x{j}" for j in range(X.shape[1])]
    r = hierarchy.hierarchical(points(spark, X), cols, 4, "single")
    heights = [m.height for m in r.merges.orderBy("step").collect()]
    assert heights == pytest.approx(prim(X, 2.0))
    found, by_number = sets(r.labels)
    assert len(found) == 4 and sorted(by_number) == [0, 1, 2, 3]
    assert sorted(by_number, key=lambda c: min(by_number[c])) == [0, 1, 2, 3]
    if heights[-4] < heights[-3] - 1e-9:         # else the cut has ties
        assert found == parts_below(X, heights[-4])


@pytest.mark.parametrize("metric", ["cosine"])
def test_single_metrics(spark, small_cells, metric):
    X = np.random.default_rng(4).normal(size=(60, 2)) + 3
    r = hierarchy.hierarchical(points(spark, X), ["x0", "x1"], 2, "single", metric=metric)
    if metric == "cosine":
        U = X / np.linalg.norm(X, axis=1)[:, None]
        want = [d * d / 2 for d in prim(U, 2.0)]
    else:
        want = prim(X, hierarchy.METRICS[metric])
    assert [m.height for m in r.merges.orderBy("step").collect()] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("kind", ["clumps", "repeats"])
def test_ward_over_cells(spark, small_cells, kind):
    X = shape(kind, 110, np.random.default_rng(5))
    cols = [f"x{j}" for j in range(X.shape[1])]
    r = hierarchy.hierarchical(points(spark, X), cols, 5, "ward")
    chain = hierarchy.nn_chain(X, np.ones(len(X)), "ward")
    heights = [m.height for m in r.merges.orderBy("step").collect()]
    assert len(heights) == len(X) - 1
    if kind == "repeats":        # equal heights may be merged in another order
        assert heights[:20] == pytest.approx(sorted(chain[:, 2])[:20], abs=1e-9)
        return
    assert heights == pytest.approx(sorted(chain[:, 2]), rel=1e-9)
    found, _ = sets(r.labels)
    want = {}
    for i, c in enumerate(hierarchy.cut(chain, len(X), 5)):
        want.setdefault(c, set()).add(i)
    assert found == {frozenset(v) for v in want.values()}


def test_string_ids_one_row_and_errors(spark):
    one = frame(spark, [("a", 1.0)], "k string, x0 double")
    for link in ("single", "ward"):
        r = hierarchy.hierarchical(one, ["x0"], 1, link, "k")
        assert [tuple(x) for x in r.labels.collect()] == [("a", 0)] and r.merges.count() == 0
        three = frame(spark, [("c", 1.0), ("a", 9.0), ("b", 1.1)], "k string, x0 double")
        r = hierarchy.hierarchical(three, ["x0"], 2, link, "k")
        assert {x.k: x.cluster for x in r.labels.collect()} == {"a": 0, "b": 1, "c": 1}
    for wrong in (dict(metric="manhattan"), dict(metric="none"), dict(n_clusters=0), dict(linkage="median")):
        with pytest.raises(ValueError):
            hierarchy.hierarchical(one, ["x0"], **{"n_clusters": 1, "id": "k"} | wrong)
    with pytest.raises(ValueError, match="missing"):
        hierarchy.hierarchical(frame(spark, [(1, None), (2, 1.0)], "id int, x0 double"), ["x0"], 1, "single")


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7)]
    edges += [tuple(map(int, e)) for e in rng.integers(300, 340, (30, 2))]
    got = {r.node: r.component for r in connected_components(frame(spark, edges, "a long, b long")).collect()}
    import collections
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want


@pytest.mark.parametrize("linkage, kind, metric", [("complete", "clumps", "euclidean"), ("average", "normal", "cosine")])
def test_complete_and_average_over_cells(spark, small_cells, monkeypatch, linkage, kind, metric):
    """Rounds and the table of blocks give the chain's tree; a table of any size was an error or one driver's work."""
    monkeypatch.setattr(hierarchy, "FEW", 30)
    monkeypatch.setattr(hierarchy, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hierarchy, "CHUNK", 1 << 10)
    X = shape(kind, 110, np.random.default_rng(8))
    X[5], X[80] = X[44], X[44]                       # a place that three rows share
    cols = [f"x{j}" for j in range(X.shape[1])]
    r = hierarchy.hierarchical(points(spark, X), cols, 5, linkage, metric=metric)
    U = X / np.linalg.norm(X, axis=1)[:, None] if metric == "cosine" else X
    chain = hierarchy.nn_chain(U, np.ones(len(X)), linkage, 2.0, metric == "cosine")
    assert [m.height for m in r.merges.orderBy("step").collect()] == pytest.approx(sorted(chain[:, 2]), abs=1e-9)
    want = {}
    for i, c in enumerate(hierarchy.cut(chain, len(X), 5)):
        want.setdefault(c, set()).add(i)
    assert sets(r.labels)[0] == {frozenset(v) for v in want.values()} and r.exact


def test_average_has_no_cap(spark):
    """4,001 rows were an error."""
    X = np.random.default_rng(9).integers(0, 40, (4001, 1)).astype(float)
    assert hierarchy.hierarchical(points(spark, X), ["x0"], 3, "average").labels.count() == 4001
