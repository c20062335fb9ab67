"""Targets against plain water-filling, copies against their draws."""

import hashlib
import random

import pytest

from tablelearn.llm import mixing
from tablelearn.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, SOURCE string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Give each source its weight's share, cut it at the cap, share the rest anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, left, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        for s in free:
            goal[s] += left * weight[s] / w
        left = sum(max(0, goal[s] - cap * sizes[s]) for s in free)
        for s in list(free):
            if goal[s] >= cap * sizes[s]:
                goal[s] = cap * sizes[s]
                free.discard(s)
    return goal


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "src10", "src9", "𝒳", "ａ"][:rng.randint(1, 10)]
    sizes = {s: rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for s in names}
    df = Scratch(spark).write(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def docs(n=3000):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(n)]
    return rows + [(n, None, "a", None), (None, "w", "b", None), (5, *rows[5][1:]), (n + 1, "", "empty", None)]


def test_copies(spark):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.with_copies(df).collect()
    assert len(out) == len(rows)
    taken, goal = {}, {}
    for r in out:
        rate = r.target / r.source_size if r.source_size else 0
        key = f"mix-1:{'null' if r['_0'] is None else r['_0']}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (u < rate - int(rate))
        assert r.size == len((r["_1"] or "").split()) and r.size * r.copies <= 2 * r.size
        taken[r["_2"]] = taken.get(r["_2"], 0) + r.size * r.copies
        goal[r["_2"]] = r.target
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(0.1 * g, 60)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(df).collect()))


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.with_copies(df).count() == 0
    none = spark.createDataFrame([(1, None, "a", None), (2, " \t\n", None, None)], SCHEMA)
    assert {(r.size, r.target, r.copies) for r in mixing.with_copies(none).collect()} == {(0, 0.0, 0)}


def test_words_are_ascii_separated(spark):
    df = spark.createDataFrame([(1, "a b c\x0b\x0cd\x1ce　f", "s", None)], SCHEMA)
    assert mixing.with_copies(df).first()["size"] == 3
