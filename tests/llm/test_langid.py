"""n-gram counts against a plain loop, accuracy on held-out rows, odd rows."""

import base64
import collections
import random
import zlib

import numpy as np

from tablelearn.llm import langid
from tablelearn.llm.queries import QUERIES
from tests.conftest import SF01


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = " " + " ".join(words) + " "        # the leading space itself is no gram
    grams = collections.Counter(s[i:i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
    return grams, sum(map(len, words))


def test_gram_counts(monkeypatch):
    texts = ["a", "Ab, c!  d", "  x  ", "éa-b 12 c", "日本 語", "one\ntwo"]
    whole = [langid.gram_counts(t) for t in texts]
    for t, (c, n) in zip(texts, whole, strict=True):
        grams, letters = plain_counts(t)
        assert n == letters and c.sum() == sum(grams.values()) - 1
        assert (c > 0).sum() <= len(grams)
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(langid, "SLICE", size)
        for t, (c, n) in zip(texts, whole, strict=True):
            got = langid.gram_counts(t)
            assert got[1] == n and (got[0] == c).all(), (t, size)
    assert langid.gram_counts(None)[1] == langid.gram_counts("12 !?")[1] == 0


def test_kmeans_centroids_are_unit_and_distinct():
    rng = np.random.default_rng(0)
    x = rng.random((50, langid.DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 4)
    assert c.shape == (4, langid.DIM) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    assert len(langid.spherical_kmeans(np.repeat(x[:1], 9, 0), 4)) == 1


def test_query_and_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op2_langid"](spark, SF01).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_rejection_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(400)
    model = langid.fit(docs)
    rows = [(1, "搜索引擎優化は難しい" * 30, "x"), (2, None, None), (3, "12 !?", "y"), (4, "", "z"),
            (5, "The of and that with the this", None), (5, "The of and that with the this", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    out = collections.defaultdict(list)
    for r in langid.predict(df, model).collect():
        out[r.doc_id].append((r.lang_pred, r.rejected))
    assert out[1][0][1] and out[1][0][0] in set(model.langs)
    assert out[2] == out[3] == out[4] == [("und", True)]
    assert out[5] == [("en", False)] * 2
    assert langid.predict(df.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "!", "en")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([(1, "abc abd", "xx")], df.schema))
    assert [r.lang_pred for r in langid.predict(df, one).collect()] == ["xx", "und"]


def test_foreign_and_random_text_is_rejected_at_every_length(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    rng = random.Random(5)
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu "
               "järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ") * 30
    word = lambda first, last: "".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 9)))
    for n in (120, 300, 1000, 3500):
        texts = [finnish[at:at + n] for at in range(10)]
        for first, last in ((97, 122), (0x430, 0x44f), (0x4e00, 0x9fff)):
            texts += [" ".join(word(first, last) for _ in range(n // 6)) for _ in range(10)]
        texts += [base64.b64encode(rng.randbytes(n * 3 // 4)).decode() for _ in range(10)]
        assert all(rejected for _, _, rejected in model.predict(texts)), n
    held = [r.text for r in docs.where(langid.held_out(docs["doc_id"])).collect()]
    clean = [r for t, r in zip(held, model.predict(held), strict=True) if t and langid.gram_counts(t)[1]]
    assert sum(rejected for _, _, rejected in clean) <= 0.02 * len(clean)
