"""Shares, runs and whole results against exact arithmetic in plain Python."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablelearn.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, LANG string, `text.x` int"


def plain(rows, least=3, top=200):
    """The result by definition."""
    terms = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        mine = sorted(s for x, s in groups if x == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in mine}, shares(whole)
        for s in mine:
            pairs = [(sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in mine if o != s]
            best = [((p[s][t] - q[t])**2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def rows(seed, n, words, langs, sources):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdEFéß漢") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [(" -1.".join(rng.choice(vocabulary[:rng.choice([words, 9])]) for _ in range(rng.randint(0, 30))) or None,
             rng.choice(langs), rng.choice(sources)) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(data)], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_whole_result(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", (7, 100, 1 << 18)[seed])
    monkeypatch.setattr(divergence, "SLICE", (300, 5000, 16 << 20)[seed])
    data = rows(seed, 400, 200, ["en", "de", None, ""], ["a", "a", "a", "B", "é", None, "z"])
    data += [("rare", "fr", "a"), ("unique", "fr", "b"), (None, "fr", None), ("x y", "one", "only")]
    data += [data[0]] * 5
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, data), top=20).collect())
    assert got == plain(data, top=20)
    assert ("fr", "a", "pair", "", 0, 1) in got


def test_empty_table_and_one_group(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert divergence.audit(frame(spark, [("a b", "en", "s")] * 3)).collect() == []
    alone = divergence.audit(frame(spark, [(None, None, None), ("", "", "t")])).collect()
    assert sorted(tuple(r) for r in alone) == [("", "", "pair", "t", 0, 1), ("", "t", "pair", "", 0, 1)]


def test_terms_of_odd_texts():
    texts = ["", "A", "Ab\x00c", " x ", "a1b_c", "ÀÉ漢 Z", "{|}~\x7f", "é" * 5000, "a" * 5000 + " " * 5000]
    lists = divergence.split_terms(pa.array(texts)).to_pylist()
    plain = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t) for t in texts]
    assert [[w for w in x if w] for x in lists] == [
        [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in x] for x in plain]
    sliced = divergence.split_terms(pa.array(["zz", *texts])[1:]).to_pylist()
    assert sliced == lists


def test_exact_shares_of_large_counts():
    rng = random.Random(1)
    for _ in range(500):
        n, v = rng.randint(0, 8 * 10**15), rng.randint(1, 10**9)
        c = rng.randint(0, n)
        assert divergence.share(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 1) // (n + v)


def test_share_of_columns(spark):
    from pyspark.sql import functions as F
    rng = random.Random(2)
    data = []
    for _ in range(300):
        n, v = rng.randint(0, 8 * 10**15), rng.randint(1, 10**9)
        data.append((rng.randint(0, n), n, v))
    df = spark.createDataFrame(data, "c long, n long, v long")
    for r in df.withColumn("p", divergence.share_column(F.col("c"), F.col("n"), F.col("v"))).collect():
        assert r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v)


def test_runs():
    rng = random.Random(3)
    for _ in range(500):
        column = [rng.choice([0, 0, 1, 1, 2]) for _ in range(rng.randint(1, 30))]
        place = np.flatnonzero(column)
        ends, counts = divergence.run_ends(place, np.array(column)[place], len(column))
        assert np.repeat(counts, np.diff(ends, prepend=0)).tolist() == column
        assert (np.diff(counts) != 0).all()


def test_memory_of_a_slice():
    """Several workers share an executor's memory; slices of 16 MB took over 200 MB of each."""
    rng, size = random.Random(3), 0
    texts = []
    while size < divergence.SLICE:
        texts.append(" ".join(f"w{rng.randrange(30_000)}".translate(str.maketrans("0123456789", "abcdefghij"))
                              for _ in range(400)))
        size += len(texts[-1])
    names = pa.array(["a"] * len(texts))
    tracemalloc.start()
    out = divergence.count_slice(names, names, pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > 20_000 and peak < 64 << 20
