"""Exact neighbours over many cells against all distances."""

import math

import numpy as np
import pytest

from tablelearn.functions import cells
from tablelearn.operators import knn, neighbors

from conftest import frame


def table(spark, X, first=0):
    return frame(spark, [(first + i, *map(float, x), f"p{i % 3}") for i, x in enumerate(X)],
                 "id long, " + ", ".join(f"x{j} double" for j in range(X.shape[1])) + ", lab string")


def plain(Q, R, k, p, first):
    out = set()
    for i, q in enumerate(Q):
        diff = np.abs(R - q)
        d = diff.max(axis=1) if math.isinf(p) else (diff ** p).sum(axis=1) ** (1 / p)
        for rank, j in enumerate(np.lexsort([np.arange(len(R)), np.round(d, 9)])[:k], 1):
            out.add((i, first + int(j), rank, f"p{j % 3}", round(float(d[j]), 8)))
    return out


def data(kind, n, rng):
    if kind == "third":           # a third of the rows in one place
        X = rng.normal(size=(n, 2))
        X[rng.random(n) < 0.34] = (0.5, -0.0)
        return X
    if kind == "grid":
        return rng.integers(0, 8, (n, 2)).astype(float)
    if kind == "apart":
        return rng.normal(size=(n, 2)) + rng.integers(0, 2, (n, 1)) * 1e4
    return rng.normal(size=(n, 20))


@pytest.mark.parametrize("kind,p", [("third", 2.0), ("grid", 1.0), ("apart", math.inf), ("wide", 2.0)])
def test_neighbours_over_cells(spark, monkeypatch, kind, p):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    R, Q = data(kind, 300, rng), data(kind, 120, rng)
    Q[:5] += 50                                     # far outside
    got = neighbors.knn(table(spark, Q), table(spark, R, 1000), [f"x{j}" for j in range(R.shape[1])], 7, p,
                        payload=["lab"])
    assert {(r.q, r.r, r["rank"], r.lab, round(r.dist, 8)) for r in got.collect()} == plain(Q, R, 7, p, 1000)


def test_more_neighbours_than_a_cell_or_the_table_holds(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 8)
    R = np.random.default_rng(2).normal(size=(60, 1))
    for k in (25, 100):
        got = neighbors.knn(table(spark, R), table(spark, R), ["x0"], k, payload=["lab"])
        assert {(r.q, r.r, r["rank"], r.lab, round(r.dist, 8)) for r in got.collect()} == plain(R, R, k, 2.0, 0)


def test_rows_in_few_dimensions_meet_few_cells(spark, monkeypatch):
    """At four times the rows, about four times as many query rows are sent to other cells."""
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    sent, rng = [], np.random.default_rng(3)
    reach = cells.reach
    monkeypatch.setattr(cells, "reach", lambda *a: sent.append(reach(*a)) or sent[-1])
    counts = []
    for n in (800, 3200):
        X = table(spark, rng.random((n, 2)))
        neighbors.knn(X, X, ["x0", "x1"], 5)
        counts.append(sum(len(r.p) for r in sent.pop().collect()))
    assert 0 < counts[1] < 6 * counts[0] and counts[1] < 3200 * 4


@pytest.mark.parametrize("scale", [1.0, 1e8])
def test_wide_blocks_are_exact(scale):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(400, 64)) + scale
    r[100:200] = r[:100]
    q = np.concatenate([r[:50], rng.normal(size=(50, 64)) + scale])
    ids = rng.permutation(400)
    order, d = neighbors.block_top_k(q, r, ids, 9, 2.0)
    full = neighbors.minkowski(q, r)
    want = np.lexsort([np.broadcast_to(ids, full.shape), np.round(full, 9)], axis=1)[:, :9]
    assert (order == want).all() and d == pytest.approx(np.take_along_axis(full, want, axis=1), rel=1e-12)


def test_missing_features_are_an_error(spark):
    X = frame(spark, [(1, 1.0), (2, None)], "id int, x0 double")
    with pytest.raises(ValueError, match="missing"):
        neighbors.knn(X, X, ["x0"], 1)


def test_blocks_meet_without_a_broadcast(spark, capsys):
    """What ``reach`` gives is far larger than its estimate; broadcast, it filled the driver."""
    blocks = cells.pack(cells.with_cell(frame(spark, [(i, [float(i)]) for i in range(20)], "id long, x array<double>"),
                                        cells.Splits(np.zeros(0, np.int64), np.zeros(0), 0), 20))
    pairs = cells.compare(blocks, blocks, lambda q, r: [q["id"], r["id"]], [("a", "long"), ("b", "long")], write=False)
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i) for i in range(20)}


@pytest.mark.parametrize("width", [2, 3])
def test_imputation_meets_few_cells(spark, monkeypatch, width):
    """Every row with a missing feature was compared with all rows; now as by ``neighbors.knn``."""
    rng = np.random.default_rng(width)
    x = np.column_stack([rng.integers(0, 30, 2000), *rng.normal(size=(width - 1, 2000)).round(2)]).astype(object)
    x[rng.random(x.shape) < 0.15] = None
    rows = [(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(x)]
    rows += rows[:20] + [(None, 3.0, *[None] * (width - 1))]
    feats = [f"x{j}" for j in range(width)]
    df = frame(spark, rows, "id long, " + ", ".join(f"{c} double" for c in feats))
    blocks = knn.impute_knn(df, feats, k=4).collect()
    monkeypatch.setattr(knn, "SMALL_PAIRS", 0)
    monkeypatch.setattr(knn, "_by_blocks", None)
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    pairs, reach = [], cells.reach
    monkeypatch.setattr(cells, "reach", lambda *a: pairs.append(reach(*a)) or pairs[-1])
    found = knn.impute_knn(df, feats, k=4).collect()
    key = lambda r: tuple(round(v, 9) if v is not None else -1e9 for v in r)
    assert [pytest.approx(key(r), abs=1e-8) for r in sorted(found, key=key)] == sorted(map(key, blocks))
    if width == 2:
        assert 0 < sum(len(r.p) for t in pairs for r in t.collect()) < 6 * len(rows)


def test_blocks_are_compared_in_slices(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablelearn.functions import cells
    monkeypatch.setattr(cells, "PAIRS", 400)          # read where compare is built into the task, on the driver
    pts = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("x"),
                                  F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("block"))
    held = cells.pack(pts)
    seen = cells.compare(held, held, lambda q, r: [np.array([len(q["x"])]), np.array([len(r["x"])])],
                         [("n", "bigint"), ("m", "bigint")]).collect()
    assert sum(r.n for r in seen) == 100 and all(r.n * r.m <= 400 for r in seen)


def test_tsne_repulsion_in_slices(monkeypatch):
    from tablelearn.operators import tsne
    rng = np.random.default_rng(0)
    y, cm, cn = rng.normal(size=(50, 2)), rng.normal(size=(9, 2)), rng.integers(1, 5, 9).astype(float)
    monkeypatch.setattr(tsne, "STEP_ROWS", 7)
    d = y[:, None] - cm[None]
    q = 1 / (1 + (d ** 2).sum(2))
    assert np.allclose(tsne._repulsion(y, cn, cm), ((cn * q * q)[:, :, None] * d).sum(1), atol=1e-12)


def test_tsne_ways_of_a_step_agree(spark, monkeypatch):
    from tablelearn.operators import tsne
    rng = np.random.default_rng(3)
    # ids that come twice move together; a record holds fewer edges than some points have
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(40, 2)))]
    df = frame(spark, rows + rows, "id long, x0 double, x1 double")
    got = []
    for task, driver, edges in ((100, 100, 16_384), (0, 100, 10), (0, 0, 10)):
        monkeypatch.setattr(tsne, "TASK_POINTS", task)
        monkeypatch.setattr(tsne, "DRIVER_POINTS", driver)
        monkeypatch.setattr(tsne, "EDGES", edges)
        emb, kl = tsne.embed(df, ["x0", "x1"], max_iter=4)
        got.append((sorted(map(tuple, emb.collect())), kl))
    assert len(got[0][0]) == 80
    for emb, kl in got[1:]:
        assert np.allclose(emb, got[0][0], atol=1e-9) and abs(kl - got[0][1]) < 1e-9


def test_tsne_kl_runs_all_steps(spark, tmp_path):
    from tablelearn.operators import tsne
    from tablelearn.plans import clustering
    from tablelearn.sources import tables
    rng = np.random.default_rng(4)
    frame(spark, [(i, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(60, 2)))],
          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    row = clustering.tsne_kl(spark, str(tmp_path)).first()
    kl = tsne.embed(tables.f_learn(spark, str(tmp_path)), ["x0", "x1"], id="vec_id")[1]      # 1000 steps by default
    assert row["steps"] == 1000 and abs(row["kl"] - kl) < 1e-9
