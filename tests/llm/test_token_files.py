"""Ids against the tokenizers library, planes and files against exact round trips."""

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablelearn.llm import token_files
from tablelearn.llm.common import Scratch
from tablelearn.llm.queries import BYTE_MODEL, QUERIES
from tests.conftest import SF001


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_MODEL)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def folder(spark):
    return f"{Scratch(spark).base}/tokens-{uuid.uuid4().hex}"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", token_files.KINDS)
@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000, 65536])
def test_planes(kind, n):
    rng = np.random.default_rng(n)
    for top in (2, 300, 50257, 2**32):
        ids = rng.integers(0, top, n).astype("<u4")
        blob = token_files.pack(ids, kind)
        assert (token_files.unpack(blob) == ids).all()
    assert len(token_files.pack(np.zeros(65536, "<u4"), kind)) < 2000
    with pytest.raises(ValueError):
        token_files.unpack(b"x" * 40)


def test_words_like_whole_texts(library):
    rng = random.Random(3)
    bits = [" ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "a", "The", "über", "'s", "'", "12",
            ",", "...", "<|endoftext|>", "<|", "é", "é", "漢字", "🙂", "\x00", "x" * 300, "日", "Ġ", "\r\n", "word.", "a.", ".", "word", *" \n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    with open(BYTE_MODEL) as f:
        model = f.read()
    enc = token_files.Encoder(model, words=500)              # so that the cache is emptied now and then
    for lo in range(0, len(texts), 700):
        part = texts[lo:lo + 700]
        ids, counts = enc.encode(pa.array(part), 9)
        for t, got in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == [*library(t), 9], repr(t)
        assert len(enc.cache) <= 500 + 700 * 12
    for part in ([], [None], ["", None, "x"], ["<|endoftext|>"]):
        ids, counts = enc.encode(pa.array(part, pa.string()), 2)
        assert ids.tolist() == [x for t in part for x in (*library(t), 2)] and len(counts) == len(part)
    plain = token_files.Encoder(model, special_as_text=True)
    assert 50256 not in plain.encode(pa.array(["a <|endoftext|> b"]), 2)[0]


def test_crc_of_parts():
    rng = random.Random(4)
    for _ in range(200):
        parts = [rng.randbytes(rng.randint(0, 40)) for _ in range(rng.randint(1, 6))]
        assert token_files.joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def plain(rows, library, end=2):
    """(id, start, n, crc) of rows in order."""
    out, at = [], 0
    for i, t in rows:
        ids = [*library(t), end]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 100), ("byte", 1 << 16)])
def test_files(spark, library, kind, block):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "word", "Zeit", "#", "x\n", ""]) for _ in range(rng.randint(0, 60))))
            for i in range(-150, 150)]
    rows += [(1000, "long " * 5000), (1001, None), (1002, "")]
    shuffled = [(i, t, 1, "x") for i, t in rows]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string, TEXT int, `doc.id` string")
    path = folder(spark)
    token_files.write_tokens(df, path, BYTE_MODEL, block=block, planes=kind)
    got = sorted(tuple(r) for r in token_files.read_documents(spark, path).collect())
    want = plain(rows, library)
    assert got == want
    chunks = spark.read.parquet(f"{path}/chunks")
    per = {}
    for r in chunks.select("shard", "chunk", "n").collect():
        per.setdefault(r.shard, {})[r.chunk] = r.n
    for sizes in per.values():
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(sizes[k] == block for k in range(len(sizes) - 1)) and 0 < sizes[len(sizes) - 1] <= block
    index = sorted((r.start, r.n, r.n_bytes) for r in spark.read.parquet(f"{path}/index").collect())
    assert [s for s, _, _ in index] == [sum(n for _, n, _ in index[:k]) for k in range(len(index))]
    stream = [x for i, t in rows for x in (*library(t), 2)]
    total = want[-1][1] + want[-1][2]
    assert len(stream) == total
    for lo, hi in ((0, total), (5, 6), (63, 65), (total - 1, total + 50), (700, 1900), (9, 9)):
        found = sorted((r.start, r.ids) for r in token_files.read_range(spark, path, lo, hi).collect())
        assert [x for _, ids in found for x in ids] == stream[lo:hi]


def test_repeated_and_null_ids(spark, library):
    rows = [(None, "b"), (None, "b"), (None, None), (3, "c d"), (3, "c d"), (3, "e"), (1, "a " * 500)]
    path = folder(spark)
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTE_MODEL, block=16)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None] * 3 + [1] + [3] * 3
    assert sorted((r.id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc([*library(t), 2])) for i, t in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_empty_table(spark):
    path = folder(spark)
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, BYTE_MODEL)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_files.read_range(spark, path, 0, 10).count() == 0


def test_string_ids_and_bad_arguments(spark, library):
    path = folder(spark)
    df = spark.createDataFrame([("é", "x"), ("a", "y z")], "k string, t string")
    token_files.write_tokens(df, path, BYTE_MODEL, id="k", text="t", end=7)
    got = sorted(tuple(r) for r in token_files.read_documents(spark, path).collect())
    assert got == plain([("a", "y z"), ("é", "x")], library, end=7)
    with pytest.raises(ValueError):
        token_files.write_tokens(df, path, BYTE_MODEL, id="k", text="t", planes="nibble")


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = plain(sorted((r.doc_id, r.text) for r in rows), library)
    out = QUERIES["op13_token_files"](spark, SF001)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in out.collect()) == want
