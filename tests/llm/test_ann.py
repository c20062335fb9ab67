"""Recall against brute force, exact scores, balance, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.llm import ann
from tablelearn.llm.queries import QUERIES
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<double>, VEC_ID string"


def brute(ids, x, k=20):
    out = {}
    for i, (q, v) in enumerate(zip(ids, x, strict=True)):
        if q % 20 == 0:
            s = (v * x).sum(1)
            at = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in at]
    return out


def assert_recall(rows, want, least):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= least * sum(map(len, want.values()))
    for q in want:
        assert len(got[q]) == len(want[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))


@pytest.mark.parametrize("clustered", (False, True))
def test_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.standard_normal((n, 24))
    if clustered:
        x = 0.3 * x + rng.standard_normal((40, 24))[rng.integers(40, size=n)]
        x[:700] = x[0]                                  # a vector that is there many times
    ids = rng.permutation(n) * 4
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], SCHEMA)
    rows = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(ids, x)
    if clustered:      # ties are part of the answer
        assert_recall(rows, want, 0.9)
        by_id = dict(zip(ids.tolist(), x, strict=True))
        assert all(r.score == float((by_id[r.query_id] * by_id[r.vec_id]).sum()) for r in rows)
    else:
        assert_recall(rows, want, 0.9)


def test_balanced_parts_cut_few_edges():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((16, 12))[rng.integers(16, size=1200)] + 0.2 * rng.standard_normal((1200, 12))
    graph = ann.neighbour_graph(x)
    part = ann.balanced_parts(x, graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= np.ceil(ann.SLACK * 150) and sizes.min() > 0
    assert (part[graph] == part[:, None]).mean() > 0.7
    router = ann.train_router(x, 8, 12)
    assert router.order(x).shape == (1200, 8)


def test_small_parts_give_k_all_the_same(spark, monkeypatch):
    """Parts of a few rows each and one probe: the search goes on until k are found."""
    monkeypatch.setattr(ann, "parts_for", lambda n: 16)
    monkeypatch.setattr(ann, "_tune", lambda *a: 1)
    x = np.random.default_rng(4).standard_normal((120, 6))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    out = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert {q: sorted(r["rank"] for r in out if r.query_id == q) for q in range(0, 120, 20)} == {
        q: list(range(1, 21)) for q in range(0, 120, 20)}
    few = ann.search(spark.createDataFrame(rows[:15], SCHEMA), F.col("vec_id") == 0).collect()
    assert len(few) == 14


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (20, [0.0, 2.0], "x"), (None, [1.0, 1.0], "x"),
            (40, None, "x"), (60, [0.0, 0.0], "x"), (80, [None, 1.0], "x"), (100, [float("nan"), 1.0], "x"),
            (120, [1.0], "x"), (7, [1.0, 1.0], "x"), (140, [], "x")]
    out = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    zero = [(r["rank"], r.vec_id, r.score) for r in out if r.query_id == 0]
    assert sorted(zero, key=str) == sorted(2 * [(1, 0, 1.0), (2, 7, 1.0), (3, None, 1.0), (4, 20, 0.0)], key=str)
    assert {r.query_id for r in out} == {0, 20}
    assert ann.search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    one = ann.search(spark.createDataFrame(rows[:1], SCHEMA), F.lit(True))
    assert one.count() == 0


def test_query_recall(spark):
    data = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in data])
    x = np.array([r.embedding for r in data], np.float64)
    assert_recall(QUERIES["op5_ann"](spark, SF01).collect(), brute(ids, x), 0.9)
