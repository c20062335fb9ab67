"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from tablelearn.llm import spm
from tablelearn.llm.queries import PIECE_MODEL, QUERIES
from tests.conftest import SF001


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return spm.PieceModel(f.read())


def assert_same(model, library, texts):
    ids, counts = model.encode(texts)
    edge = np.append(0, np.cumsum(counts))
    got = [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    want = library.encode(texts)
    assert got == want
    assert model.decode(ids, counts) == [library.decode(x) for x in want]


def test_odd_texts(model, library):
    assert_same(model, library, [
        "", " ", "  ", " a", "a ", "▁", "▁▁a b", "a  b   c", "\n", "a\n\nb", "\t\r\n", "<s>", "</s><0x0A>",
        "日本語 テスト", "𝒳é̂", "a" * 5000, " " * 400, "ab" * 3000, "the " * 800, "x" * 20001])


def test_random_mixtures(model, library):
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "é", "▁", "日", "語", "𝒳", "<0x0A>", "e", "r", "th", "in", "    ", "0"]
    names = rng.sample(sorted(model.by_name), 3000)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(names) for _ in range(8)) for _ in range(4000)]
    assert_same(model, library, texts)


def test_long_runs(model, library, monkeypatch):
    """Words whose rounds merge one pair each: right, and in time that grows with their length."""
    monkeypatch.setattr(spm, "PATIENCE", 2)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["  ", "     ", "a" * 9, "=" * 7, "-", "\n\n\n", "日日日"]) * rng.randint(1, 9)
                     for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    assert_same(model, library, texts)
    monkeypatch.undo()
    begin = time.perf_counter()
    assert_same(model, library, [" " * 60_000, "x" + " " * 20_001 + "y", "=" * 20_000, "ab" + "-" * 9_999])
    assert time.perf_counter() - begin < 20                # 20,000 spaces alone took 30 s in single rounds


def test_cache_starts_anew(model, library, monkeypatch):
    monkeypatch.setattr(spm, "CACHE_WORDS", 3)
    assert_same(model, library, ["one two three four five"])
    assert_same(model, library, ["two six seven"])


def test_bytes_that_are_no_text(model, library):
    ids = [model.byte_id[b] for b in (0xE6, 0x97, 0x41, 0xFF)]
    assert model.decode(np.array(ids), np.array([4])) == [library.decode([int(i) for i in ids])]


def test_frames(spark, library):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "é\n" * 9, "z")]
    df = spark.createDataFrame(rows, "id long, text string, `odd.name` string")
    out = spm.decode(spm.encode(df, PIECE_MODEL), PIECE_MODEL)
    assert out.columns == ["id", "text", "odd.name", "decoded"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(i, t, o, t or "") for i, t, o in rows], key=str)
    assert spm.encode(df.limit(0), PIECE_MODEL).count() == 0
    clash = spm.encode(df.withColumnRenamed("id", "IDS").withColumnRenamed("odd.name", "TEXT"), PIECE_MODEL)
    assert clash.columns == ["text", "TEXT", "ids"] and clash.count() == 5


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, SF001).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids))
