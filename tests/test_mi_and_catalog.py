"""Mutual information vs a brute-force estimator; catalog contract."""

import math

import numpy as np
import pytest

from tablelearn.operators import mutual_info as mi

from conftest import SF001, frame


def psi(x):
    x, s = float(x), 0.0
    while x < 6:
        s -= 1 / x
        x += 1
    return s + math.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)


def brute_cd(c, d, k=3):
    n = len(c)
    r, kall, lc = np.zeros(n), np.zeros(n), np.zeros(n)
    for lab in np.unique(d):
        m = d == lab
        idx = np.where(m)[0]
        if m.sum() > 1:
            kk = min(k, m.sum() - 1)
            for i in idx:
                r[i] = np.sort(np.abs(c[idx] - c[i]))[1:][kk - 1]
                kall[i] = kk
        lc[m] = m.sum()
    mask = lc > 1
    mm = [np.sum(np.abs(c[mask] - c[i]) < r[i]) for i in np.where(mask)[0]]
    return max(0.0, psi(mask.sum()) + np.mean([psi(x) for x in kall[mask]])
               - np.mean([psi(x) for x in lc[mask]]) - np.mean([psi(x) for x in mm]))


def test_mi_classif_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=120)
    y = (x + rng.normal(size=120) > 0).astype(int)
    df = frame(spark, [(i, float(x[i]), int(y[i])) for i in range(120)],
               "id long, x double, y int")
    got = mi.mi_classif(df, ["x"], "y").first().score
    assert got == pytest.approx(brute_cd(x, y), abs=1e-8)


def test_digamma():
    from pyspark.sql import functions as F
    assert callable(mi.digamma)
    _ = F


def test_catalog_contract(spark):
    import __spark_entry__ as ent
    qs, sql = ent.queries(), ent.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100
    out = ent.entry(spark)
    assert out.count() > 0
    assert {"class", "precision", "recall", "f1", "support"} == set(out.columns)
    _ = SF001


def test_radii_over_chunks_of_ranks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=300), rng.integers(0, 3, 300)
    df = frame(spark, [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y int")
    monkeypatch.setattr(mi, "CHUNK", 16)              # many chunks, whose rows need the next one's
    assert mi.mi_classif(df, ["x"], "y").first().score == pytest.approx(brute_cd(x, y), abs=1e-8)


def test_mi_classif_compares_no_offset_rows_by_joins(spark):
    df = frame(spark, [(i, float(i * i % 97), i % 2) for i in range(90)], "id long, x double, y int")
    plans, one = [], mi.cut_lineage
    try:
        mi.cut_lineage = lambda d: plans.append(d._jdf.queryExecution().toString()) or one(d)
        mi.mi_classif(df, ["x"], "y").first()
    finally:
        mi.cut_lineage = one
    assert not any("_g2" in p for p in plans)         # 2k rows for each row, joined with all
    assert any("lag(" in p for p in plans)
