"""Whole rankings against scores by definition; pruning against scoring all."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablelearn.llm import ranked_search as rs

DOCS = "doc_id long, text string, TEXT string, `a.b` int"
ITEMS = "item_id long, text string, Item_Id int"


def terms(text):
    found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def plain(docs, items, k=20):
    """Sorted (item, rank, doc, score) by definition."""
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    some, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, n):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * some // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort()
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in rs.ranked_search(d, q, **more).collect()), key=repr)


def corpus(seed, n, words=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcXé7漢") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    pick = lambda m: rng.choice([" ", "-", "\n"]).join(
        vocabulary[min(int(rng.expovariate(0.02)), words - 1)] for _ in range(m))
    docs = [(rng.randint(0, n), pick(rng.randint(0, 40))) for _ in range(n)]
    items = [(i, pick(rng.randint(0, 25))) for i in range(40)]
    docs += [(n + 1 + j, f"{t} {pick(5)}") for j, (_, t) in enumerate(items)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_whole_rankings(spark, seed, monkeypatch):
    monkeypatch.setattr(rs, "GROUP_ROWS", (50, 8192, 200)[seed])
    monkeypatch.setattr(rs, "BLOCK_ITEMS", (7, 256, 3)[seed])
    monkeypatch.setattr(rs, "ITEM_BYTES", (500, 1 << 20, 1 << 20)[seed])
    docs, items = corpus(seed, 600)
    docs += [(None, docs[0][1]), (None, None), (7, None), (8, ""), (9, docs[3][1]), (9, docs[3][1]), docs[3]]
    docs += [(10_000, "long " * 20_000 + docs[5][1])]
    items += [(1, items[1][1]), (None, items[2][1]), (50, None), (51, ""), (52, "nowhere0"), (53, "a " * 2000)]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, k=3) == plain(docs, items, k=3)


def test_ties(spark):
    docs = [(i, "same words here") for i in range(90, 0, -1)] + [(None, "same words here")] * 3
    assert run(spark, docs, [(1, "words")]) == plain(docs, [(1, "words")])
    few = docs[-5:]
    assert run(spark, few, [(1, "words here here")]) == plain(few, [(1, "words here here")])


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None), (2, " ")], [(1, "a")]) == []
    assert run(spark, [(1, "b")], [(1, "a"), (2, None)]) == []


def test_string_ids(spark):
    d = spark.createDataFrame([("x", "a b"), ("y", "a b"), ("z", "c d")], "k string, t string")
    q = spark.createDataFrame([("q", "a c")], "i string, t string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in rs.ranked_search(
        d, q, doc_id="k", text="t", item_id="i", item_text="t").orderBy("rank").collect()]
    assert got == [("q", 1, "z"), ("q", 2, "x"), ("q", 3, "y")]


@pytest.mark.parametrize("exact", [True, False])
def test_bounds_prune_without_loss(exact):
    """Far fewer pairs are scored than there are, and the best scores stay."""
    rng = np.random.default_rng(5)
    docs, topics, width = 4096, 16, 640
    at = np.sort(np.stack([rng.choice(width // topics, 12, replace=False) + width // topics * (i % topics)
                           for i in range(docs)]), axis=1)
    items = [Counter({f"t{t}": 1 for t in rng.choice(width // topics, 8, replace=False) + width // topics * (j % topics)})
             for j in range(64)]
    number, weight = {f"t{t}": t for t in range(width)}, rng.integers(1000, 9000, width)
    blocks = rs.make_blocks(items, number, weight)
    for b in blocks:
        b.exact = exact
    best, seen = rs.Best(len(items), 20), [0]
    tf = rng.integers(1, 4, at.size)
    item, row, score = rs.search_documents(
        blocks, np.arange(docs + 1) * 12, at.ravel(), tf, np.full(docs, 12), pa.array(np.arange(docs)), weight,
        docs, 12 * docs, best, seen)
    value = np.zeros((docs, width), np.int64)
    value[np.repeat(np.arange(docs), 12), at.ravel()] = 10**9 * tf // (1000 * tf + 1200)
    for j, c in enumerate(items):
        w = np.zeros(width, np.int64)
        for t in c:
            w[number[t]] = weight[number[t]]
        scores = value @ w
        want = np.lexsort([np.arange(docs), -scores])[:20]
        mine = item == j
        assert row[mine].tolist() == want.tolist() and score[mine].tolist() == scores[want].tolist()
    assert seen[0] < 0.25 * docs * len(items), seen[0] / docs / len(items)
