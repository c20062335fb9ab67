"""Links and components against brute force, blocks, odd vectors."""

import math

import numpy as np
import pytest

from tablelearn.llm import emb_dedup
from tests.llm.test_dart_minhash import plain_components

SCHEMA = "vec_id long, embedding array<double>, label int, LABEL string"


def brute(rows):
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, edges = {r[0]: 0 for r in rows}, []
    for x, a in enumerate(rows):
        for b in rows[:x]:
            if a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
                u, v = (np.array(r[1]) / np.abs(r[1]).max() for r in (a, b))
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= 0.93:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    edges.append((a[0], b[0]))
    part = plain_components(edges)
    return {r[0]: (n[r[0]], part.get(r[0], r[0])) for r in rows}


def vectors(seed, n=260, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    x = centre[rng.integers(12, size=n)] + 0.28 * rng.standard_normal((n, dim)) * rng.random((n, 1))
    return [(int(i), [float(np.float32(e)) for e in v] if i % 3 else v.tolist(), int(rng.integers(2)), "x")
            for i, v in zip(rng.permutation(n) * 7, x, strict=True)]


@pytest.mark.parametrize("block", (1024, 17))
def test_against_brute_force(spark, monkeypatch, block):
    rows = vectors(block)
    rows += [(5001, None, 1, None), (5002, [], 1, None), (5003, [0.0] * 16, 1, None),
             (5004, [float("nan")] * 16, 1, None), (5005, [None] * 16, 1, None), (5006, rows[0][1], None, None),
             (5007, [float("inf")] + [0.0] * 15, 1, None), (5008, [1e200, 1e200], 1, None),
             (5009, [3e-310, 3e-310], 1, None), (5010, [1.0, 1.01], 1, None), (5011, [1.0], 1, None)]
    monkeypatch.setattr(emb_dedup, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA)
    out = emb_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_odd_ids(spark):
    v = [1.0, 2.0]
    rows = [(None, v, 1, "x"), (3, v, 1, "x"), (3, v, 1, "x"), (9, [2.0, 4.1], 1, "x")]
    out = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept)
                 for r in emb_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (9, 3, 3, False)]
    assert emb_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_layout_grows_with_the_rows():
    last = 0
    for n in (0, 1, 10**3, 10**5, 10**8):
        bits, tables = emb_dedup.layout(n)
        same = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - same) ** tables <= emb_dedup.MISS and bits >= last
        last = bits
        assert n / 2**bits <= emb_dedup.BUCKET or bits == 62
