"""Shingles and signatures against plain code, classes against brute force."""

import collections
import random

import numpy as np
import pytest

from tablelearn.llm import dart_minhash, shingles
from tablelearn.llm.common import Scratch
from tablelearn.llm.components import components


def plain_units(text, n=5):
    """Weighted shingles of ASCII-separated text, as a counter."""
    w = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()
    return collections.Counter(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)) if w)


def plain_jaccard(a, b):
    top, bottom = sum((a & b).values()), sum((a | b).values())
    return top / bottom if bottom else 0.0


def some_texts(rng, n=40):
    vocabulary = ["alpha", "Beta", "x", "é", "日本", "12", "the", "of", "re-use", "end."]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 30, 80)))) for _ in range(n)]


def test_units_and_jaccard():
    rng = random.Random(3)
    texts = [*some_texts(rng), "", "!!!", "a a a a a a a a", "A a a, a a a"]
    e, doc = shingles.units(texts)
    sets = [e[doc == i] for i in range(len(texts))]
    plain = [plain_units(t) for t in texts]
    for i, a in enumerate(plain):
        assert len(sets[i]) == len(np.unique(sets[i])) == sum(a.values())
        for j, b in enumerate(plain[:i]):
            assert shingles.jaccard(sets[i], sets[j]) == plain_jaccard(a, b)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def test_signatures_agree_as_often_as_sets_do():
    rng = random.Random(7)
    for size in (3, 60, 4000):
        texts = []
        for _ in range(30):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            texts += [" ".join(base), " ".join(edited(rng, base, max(1, size // 60)))]
        e, doc = shingles.units(texts)
        sig = dart_minhash.signatures(e, doc, len(texts))
        true = [shingles.jaccard(e[doc == i], e[doc == i + 1]) for i in range(0, 60, 2)]
        seen = [(sig[i] == sig[i + 1]).mean() for i in range(0, 60, 2)]
        assert abs(np.mean(np.array(seen) - np.array(true))) < 0.02
        assert max(abs(a - b) for a, b in zip(true, seen, strict=True)) < 0.1
    assert not dart_minhash.signatures(*shingles.units(["", "a"]), 2)[0].any()


def plain_components(edges):
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    return {x: find(x) for x in list(part)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [[(i, i + 1) for i in range(200)],
             [(500, i) for i in range(300)] + [(i, i - 1000) for i in range(1000, 1100)],
             [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]][seed]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def classes_of(rows):
    """Brute force: equal texts, or similarity of at least the threshold."""
    plain = [plain_units(t or "") for _, t, *_ in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i)
             if (rows[i][1] or "") == (rows[j][1] or "") or plain_jaccard(plain[i], plain[j]) >= 0.8]
    part = plain_components(edges)
    return [part.get(i, i) for i in range(len(rows))]


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = some_texts(rng, 30) + ["", None, "", "!!", "?", "one", "One", "one"]
    for size in (30, 120, 400):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        texts += [" ".join(edited(rng, base, k)) for k in range(size // 40 + 1) for _ in range(4)]
        texts += [" ".join(edited(rng, base, size // 4)) for _ in range(6)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID string")
    out = {r.doc_id: r for r in dart_minhash.near_duplicates(df).collect()}
    part = classes_of(rows)
    least = {}
    for (i, *_), p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, i), i)
    assert len(out) == len(rows)
    assert {i: out[i].class_id for i in out} == {r[0]: least[p] for r, p in zip(rows, part, strict=True)}
    assert all(r.kept == (r.doc_id == r.class_id) for r in out.values())


def test_odd_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone"), (4, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id, r.kept) for r in dart_minhash.near_duplicates(df).collect())
    assert got == {(None, 4, False): 1, (4, 4, True): 3, (None, None, True): 1}
    assert dart_minhash.near_duplicates(df.limit(0)).count() == 0


def test_parities_rule_out_no_pair_of_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for size in (6, 30, 120, 400, 900):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        texts += [" ".join(edited(rng, base, k)) for k in range(size // 40 + 2) for _ in range(3)]
    e, doc = shingles.units(texts)
    rows = dart_minhash.parities(e, doc, len(texts))
    near = [(i, j) for i in range(len(texts)) for j in range(i)
            if shingles.jaccard(e[doc == i], e[doc == j]) >= 0.8]
    pad = [0] * (dart_minhash.K // 64)
    pairs = spark.createDataFrame([(pad + rows[i].tolist(), pad + rows[j].tolist()) for i, j in near],
                                  "bu array<long>, bv array<long>")
    assert len(near) > 20 and pairs.where(dart_minhash._unshared_fit("bu", "bv")).count() == len(near)


def test_a_group_just_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    """Of 120 texts with similarities of 0.75 the bits alone left 1,422 pairs to verify."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(120):
        at = rng.randrange(0, 990)
        rows.append((i, " ".join(base[:at] + [f"x{i}y{k}" for k in range(10)] + base[at + 10:])))
    rows = [(i, " ".join(t.split(" ")[:200]) + " " + " ".join(f"z{i}y{k}" for k in range(22))) for i, t in rows]
    seen, plain = [], dart_minhash._sure_links
    monkeypatch.setattr(dart_minhash, "_sure_links", lambda pairs, texts: seen.append(pairs.count()) or plain(pairs, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dart_minhash.near_duplicates(df).collect()
    part = classes_of(rows)
    least = {p: min(i for i, q in enumerate(part) if q == p) for p in part}
    assert {r.doc_id: r.class_id for r in out} == {i: least[p] for i, p in enumerate(part)}
    assert sum(seen) < 3 * len(rows)
