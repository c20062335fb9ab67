"""Each stage against brute force on a small corpus, then the whole run."""

import hashlib
import random

import pytest
import sentencepiece

import corpus_pipeline
from tablelearn.llm.queries import PIECE_MODEL
from tests.llm.test_dart_minhash import classes_of, edited
from tests.llm.test_line_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    words = {"en": ["the", "of", "and", "that", "house", "with", "thing"],
             "fr": ["le", "la", "que", "été", "maison", "avec", "où"]}
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randrange(99))])
                                  for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 3)))
        rows.append([i, text, lang, rng.choice(["a", "a", "b", None])])
    for i in range(80, 110):                       # copies and near copies
        r = rng.choice(rows[:80])
        w = edited(rng, r[1].split(" "), rng.choice((0, 1, 2)))
        rows.append([i, " ".join(w), *r[2:]])
    rows += [[200, None, None, "a"], [201, "", "en", "b"], [202, "12 34 !!", "fr", "b"], [203, "搜索引擎" * 40, None, "a"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language(spark, docs):
    out = as_rows(corpus_pipeline.language(spark, table(spark, docs), ""))
    assert out == sorted((r for r in docs if r[0] < 200), key=str)


def test_lines(spark, docs):
    out = as_rows(corpus_pipeline.lines(spark, table(spark, docs), ""))
    want = brute([r[:2] for r in docs])
    texts = {r[0]: None if r[1] is None else "\n".join(
        s for n, s in enumerate(r[1].split("\n")) if want[r[0], n] == (r[0], n)) for r in docs}
    assert out == sorted(((r[0], texts[r[0]], r[2], r[3], None if r[1] is None else len(texts[r[0]]))
                          for r in docs), key=str)
    assert any(texts[r[0]] != r[1] for r in docs)


def test_near_copies(spark, docs):
    out = as_rows(corpus_pipeline.near_copies(spark, table(spark, docs), ""))
    part = classes_of(docs)
    least = {}
    for r, p in zip(docs, part, strict=True):
        least[p] = min(least.get(p, r[0]), r[0])
    assert out == sorted((r for r, p in zip(docs, part, strict=True) if r[0] == least[p]), key=str)
    assert len(out) < len(docs)


def test_near_copies_by_row(spark):
    """One row of each group stays, whatever ids rows share or lack."""
    text = lambda k: " ".join(f"{k}word{k * n}" for n in range(40))
    ids = [(None, 1), (3, 1), (None, 2), (None, 3), (None, 3), (5, 4), (5, 4), (7, 5), (7, 6), (6, 6), (8, None), (9, None)]
    rows = [(i, None if k is None else text(k), "en", "a", 1) for i, k in ids]
    out = as_rows(corpus_pipeline.near_copies(spark, table(spark, rows), ""))
    want = [(3, 1), (None, 2), (None, 3), (5, 4), (7, 5), (6, 6), (8, None)]
    assert out == sorted(((i, None if k is None else text(k), "en", "a", 1) for i, k in want), key=str)


def test_mix_takes_words_near_the_targets(spark, docs):
    out = as_rows(corpus_pipeline.mix(spark, table(spark, docs), ""))
    size = {r[0]: len((r[1] or "").split()) for r in docs}
    assert {r[0] for r in out} <= set(size) and set(out) <= set(docs)
    assert max(out.count(r) for r in set(out)) <= 2
    total = sum(size[r[0]] for r in out)
    assert 1.2 * sum(size.values()) <= total <= 1.8 * sum(size.values())
    assert out == as_rows(corpus_pipeline.mix(spark, table(spark, docs), ""))


def test_run(spark, docs, tmp_path):
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = table(spark, docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in step.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, out)) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_empty(spark):
    step = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert step.count() == 0


def test_clashing_columns(spark, docs):
    """A column TEXT changes no stage; the one after it gets the columns of documents alone."""
    step = table(spark, docs[:40])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step.selectExpr("*", "'x' AS TEXT", "1 AS `Doc_Id`"), "")
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert as_rows(out) == as_rows(stage(spark, step, ""))
    assert out.count() == len(step.collect())
