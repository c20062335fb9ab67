"""Line classes against brute force, rebuilt texts, odd rows."""

import random

import numpy as np

from tablelearn.llm import line_dedup
from tests.llm.test_dart_minhash import plain_components


def grams(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows):
    """(id, no) -> first (id, no) of the component."""
    at = [(i, n, s.strip(" \t\r\x0b\x0c").lower()) for i, t in rows for n, s in enumerate((t or "").split("\n"))]
    sets = [grams(s) for _, _, s in at]
    edges = []
    for x in range(len(at)):
        for y in range(x):
            if at[x][2] and at[y][2]:
                both = len(sets[x] & sets[y])
                if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                    edges.append((x, y))
    part = plain_components(edges)
    first = {}
    for x, (i, n, _) in enumerate(at):
        p = part.get(x, x)
        first[p] = min(first.get(p, (i, n)), (i, n))
    return {(i, n): first[part.get(x, x)] for x, (i, n, _) in enumerate(at)}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "日", "ing", "st"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    pool = [line(rng.choice((1, 2, 5, 12, 40, 60))) for _ in range(40)]

    def variant(s):
        w = s.split(" ")
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
            w[rng.randrange(len(w))] = word()
        return rng.choice(["", "  "]) + " ".join(w) + rng.choice(["", "\r"])

    texts = ["\n".join(rng.choice([variant(rng.choice(pool)), variant(rng.choice(pool)), "", "  ", line(8)])
                       for _ in range(rng.randint(1, 8))) for _ in range(60)]
    return list(enumerate(texts)) + [(100, ""), (101, None), (102, "a"), (103, "A "), (104, "\n\n")]


def test_classes_and_texts(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, TEXT string")
    out = line_dedup.line_classes(df).collect()
    want = brute(rows)
    assert len(out) == len(want)
    assert {(r.doc_id, r.line_no): (r.class_id, r.class_line_no) for r in out} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_id, r.class_line_no)) for r in out)
    texts = line_dedup.dedupe_lines(df)
    assert texts.columns == df.columns
    assert {r.doc_id: r[1] for r in texts.collect()} == {
        i: None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if want[i, n] == (i, n))
        for i, t in rows}


def test_sets_and_coordinates():
    rng = random.Random(3)
    texts = ["a", "abc", "abcdefgh", "abcdefghi", "日本語" * 9, "aaaa" * 30, "x" * 30_000, "ab\x00", "ab"]
    texts += ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    sets = line_dedup.shingle_sets(texts)
    line = (sets >> np.uint64(40)).astype(int)
    assert np.bincount(line).tolist() == [len(grams(t)) for t in texts]
    hashes = [set((sets[line == i] & np.uint64(2**40 - 1)).tolist()) for i in range(len(texts))]
    for i, a in enumerate(texts[:40]):
        for j, b in enumerate(texts[:i]):
            assert len(hashes[i] & hashes[j]) == len(grams(a) & grams(b))
    c = line_dedup.coordinates(sets, len(texts))
    step = 2**40 // line_dedup.K
    for i in range(len(texts)):
        for k in (0, 7, 100, 255):
            assert c[i, k] == min(hashes[i], key=lambda h: (h - k * step) % 2**40)


def test_odd_rows(spark):
    same = "one line that is here again and again"
    df = spark.createDataFrame([(None, same), (1, same + "\n" + same), (1, same + "\n" + same)],
                               "doc_id long, text string")
    out = sorted(map(str, line_dedup.dedupe_lines(df).select("text").collect()))
    assert out == sorted([f"Row(text='{same}')", "Row(text='')", "Row(text='')"])
    assert line_dedup.line_classes(df.limit(0)).count() == 0


def test_isolated_pairs_at_every_length(spark):
    """Pairs barely over the threshold: few are lost at any number of shingles."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, chars_of = [], {}
    for chars in (16, 30, 60, 110, 135, 165, 240, 600):
        for _ in range(300):
            a = b = text(chars)
            if chars < 75:                               # letters added at the end
                b = a + text((chars - 7) // 4)
            else:                                        # a changed letter costs up to 8 shingles
                for _ in range((chars - 7) // 75):
                    at = rng.randrange(len(b))
                    b = b[:at] + "#" + b[at + 1:]
            assert len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))
            chars_of[len(rows)] = chars
            rows += [(len(rows), a), (len(rows) + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in line_dedup.line_classes(df).collect()}
    assert all(found[i] in (i, i - i % 2) for i in found)
    lost = [chars_of[i - 1] for i in found if i % 2 and found[i] == i]
    assert all(lost.count(n) <= 4 for n in lost), lost   # of 300; 0.5 expected at a similarity of 0.8


def test_rows_that_share_an_id_or_have_none(spark):
    """Only repeats go, and one of each stays, whatever the ids."""
    line = lambda k: f"{k} line number {k} of these rows, which is like no other one {k * 7919}"
    df = spark.createDataFrame([
        (None, f"{line(1)}\n{line(2)}"), (None, f"{line(3)}\n{line(1)}"), (None, f"{line(4)}\n{line(5)}"),
        (1, f"{line(6)}\n{line(7)}"), (1, f"{line(6)}\n{line(8)}"), (1, f"{line(9)}\n{line(10)}")],
        "doc_id long, text string")
    left = "\n".join(r.text for r in line_dedup.dedupe_lines(df).collect()).split("\n")
    assert sorted(x for x in left if x) == sorted(line(k) for k in range(1, 11))
    assert sum(r.kept for r in line_dedup.line_classes(df).collect()) == 10


def test_many_parities_rule_out_no_pair_of_the_threshold():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3, 70, 126, 135, 500, 519, 2_000, 30_000)]
    texts += [t[:-(len(t) // 9) or None] for t in texts]
    words = [w.view(np.uint64) for w in line_dedup.many_parities(texts)]
    assert [len(w) * 64 for w in words[:8]] == [256, 256, 512, 512, 2048, 2048, 8192, 16384]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            few = min(len(a), len(b))
            if max(len(a), len(b)) <= 2 * few:
                x, y = (w if len(w) == few else w[:few] ^ w[few:] for w in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= len(grams(texts[i]) ^ grams(texts[j]))


def test_large_group_just_below_the_threshold(spark, monkeypatch):
    """Lines that are all near one another, but seldom linked, are seldom compared; no link is lost."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(75)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(75), 3):
            words[at] = word()
        rows.append((i, " ".join(words) if i % 9 else " ".join(words[:72])))     # on both sides of 512 shingles
    compared, links = [], line_dedup._links

    def counted(pairs, texts):
        compared.append(pairs.count())
        return links(pairs, texts)

    monkeypatch.setattr(line_dedup, "_links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): (r.class_id, r.class_line_no) for r in line_dedup.line_classes(df).collect()}
    assert found == brute(rows)
    assert sum(compared) < 1_000, compared                   # of 4,005 pairs
