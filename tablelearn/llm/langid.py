"""Language ID by nearest centroid over normalised TF-IDF n-gram vectors.

A text becomes a vector over ``DIM`` hashed character n-grams (1 to 3 code
points of the lower-cased text, everything but letters read as one space),
with weight ``log(1 + count) * idf`` and length 1.  Document frequencies come
from all training rows.  Each language gets up to ``CLUSTERS`` centroids by
spherical k-means over a bounded sample of its training rows
(``SAMPLE_PER_LANG`` expected rows, chosen by a hash of the row).  A text gets
the language of the centroid with the largest cosine, and that cosine as its
score.

Distance-based rejection: a text is too far from everything learned if its
cosine is under ``RADIUS`` times the similarity that 99 of 100 sample rows of
about as many letters keep, in its language or in all; see ``radii``.

The model's size is languages x clusters x DIM; it is the one thing that goes
to the driver and is broadcast, and it doesn't depend on the number of rows.

Defined cases: null text, or text without a letter, gets ``und`` with score 0
and counts as rejected; ties between centroids go to the smaller language
name; repeated rows count as often as they stand there; without any training
row every text gets ``und``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_batches, need, pieces_of, take

DIM = 4096
GRAMS = 3
CLUSTERS = 4
SAMPLE_PER_LANG = 400
ROUNDS = 8
RADIUS = 0.7
LEAST_ROWS = 20            # fewer sample rows than that don't set a band's radius
SLICE = 1 << 20
BANDS = (4, 16, 64, 256, 1024)     # numbers of letters that bound the bands of radii
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a text, and its number of letters.

    Long texts go through in slices of ``SLICE`` code points.
    """
    counts, letters, text = np.zeros(DIM), 0, text or ""
    tail = np.array([32], np.uint64)                       # what the last slice ended with
    for lo in range(0, len(text), SLICE):
        cp = np.frombuffer(text[lo:lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[cp]
        letters += int(letter.sum())
        keep = letter.copy()                               # one space for each stretch
        keep[1:] |= letter[:-1]
        keep[0] |= tail[-1] != 32
        new = np.where(letter, cp, 32)[keep].astype(np.uint64)
        if lo + SLICE >= len(text) and (new[-1] if len(new) else tail[-1]) != 32:
            new = np.append(new, np.uint64(32))
        seq = np.concatenate([tail, new])
        _count(seq, len(tail), counts)
        tail = seq[1 - GRAMS:]
    return (counts, letters) if letters else (np.zeros(DIM), 0)


def _count(seq: np.ndarray, done: int, counts: np.ndarray) -> None:
    """Add the n-grams of ``seq`` that end after its first ``done`` code points."""
    h = np.zeros(len(seq), np.uint64)
    for k in range(GRAMS):
        if len(seq) <= k:
            break
        h = (h[:len(seq) - k] + seq[k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bucket = (h[max(0, done - k):] >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(bucket, minlength=DIM)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows (zero for texts without a letter) and numbers of letters."""
    out, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        c, letters[i] = gram_counts(t)
        v = np.log1p(c) * idf
        norm = np.sqrt(v @ v)
        if norm:
            out[i] = v / norm
    return out, letters


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids of unit rows; starts from rows far apart."""
    mean = x.mean(0)
    first = [int(np.argmax(x @ mean))]
    near = x @ x[first[0]]
    while len(first) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        first.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[first]
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, 1)
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def band_of(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, letters, side="right")


@dataclasses.dataclass
class Centroids:
    langs: list[str]            # by centroid
    rows: np.ndarray            # centroid x DIM
    idf: np.ndarray
    radius: dict[str, np.ndarray]   # by language: the least cosine by band of letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for lo in range(0, len(texts), 128):
            x, letters = vectors(texts[lo:lo + 128], self.idf)
            if not len(self.rows):
                out += [(UNKNOWN, 0.0, True)] * len(x)
                continue
            sim = x @ self.rows.T
            best = np.argmax(sim, 1)
            band = band_of(letters)
            for i, j in enumerate(best.tolist()):
                s = min(1.0, max(0.0, float(sim[i, j])))
                lang = self.langs[j]
                out.append((lang, s, s < float(self.radius[lang][band[i]]))
                           if letters[i] else (UNKNOWN, 0.0, True))
        return out


def low_cosines(sim: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The first percentile of the cosines by band of letters.

    A band of fewer than LEAST_ROWS rows takes half the next longer band's: a
    text with a quarter of the letters keeps half the cosine.  If no longer
    band has them it takes the next shorter band's.  A sample that has no such
    band is one band.
    """
    band = band_of(letters)
    have = [b for b in range(len(BANDS) + 1) if (band == b).sum() >= LEAST_ROWS]
    if not have:
        return np.full(len(BANDS) + 1, np.percentile(sim, 1))
    low = {b: float(np.percentile(sim[band == b], 1)) for b in have}
    for b in range(len(BANDS) + 1):
        if b > have[-1]:
            low[b] = low[have[-1]]
    for b in reversed(range(have[-1])):
        low.setdefault(b, low[b + 1] / 2)
    return np.array([low[b] for b in range(len(BANDS) + 1)])


def radii(samples: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """By language, the least cosine accepted by band of letters, of each sample's (cosines, letters).

    RADIUS times the smaller of two first percentiles: of all samples, and of
    the language's own where it has LEAST_ROWS rows in the band; never more
    than for longer texts.
    """
    pooled = low_cosines(*[np.concatenate(x) for x in zip(*samples.values(), strict=True)])
    out = {}
    for lang, (sim, letters) in samples.items():
        enough = np.bincount(band_of(letters), minlength=len(pooled)) >= LEAST_ROWS
        low = np.where(enough, np.minimum(low_cosines(sim, letters), pooled), pooled)
        out[lang] = RADIUS * np.minimum.accumulate(low[::-1])[::-1]
    return out


def _fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one language's sample, and its rows' cosines and letters."""
    pdf = pdf.sort_values(["key", "vec"])
    x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, DIM)
    c = spherical_kmeans(x, CLUSTERS)
    sim = (x @ c.T).max(1).astype(float).tolist()
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(c)),
                         "vec": [v.astype(np.float32).tobytes() for v in c],
                         "sim": [sim] + [None] * (len(c) - 1),
                         "letters": [pdf["letters"].tolist()] + [None] * (len(c) - 1)})


def fit(train: DataFrame, text: str = "text", lang: str = "lang",
        sample_per_lang: int = SAMPLE_PER_LANG) -> Centroids:
    """Learn from the rows of ``train`` whose language is not null."""
    ship_package(train.sparkSession)
    rows = take(train, text=text, lang=lang).where("lang is not null")

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(DIM, np.int64), {}
        for b in batches:
            for t, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                c, n = gram_counts(t.as_py())
                if n:
                    seen += c > 0
                    docs[name] = docs.get(name, 0) + 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({
            "lang": [None] * len(at) + list(docs), "gram": [*at.tolist(), *[None] * len(docs)],
            "n": [*seen[at].tolist(), *docs.values()]},
            schema=pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())]))

    counted = (rows.mapInArrow(document_frequency, "lang string, gram int, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect())
    per_lang = {r.lang: r.n for r in counted if r.gram is None}
    total = sum(per_lang.values())
    df = np.zeros(DIM)
    for r in counted:
        if r.gram is not None:
            df[r.gram] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    if not total:
        return Centroids([], np.zeros((0, DIM), np.float32), idf, {})

    share = F.create_map(*[F.lit(x) for k, n in sorted(per_lang.items())
                           for x in (k, min(1.0, sample_per_lang / n))])
    # a hash of the row draws the sample; equal rows count once
    key = F.xxhash64("text", "lang")
    draw = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("key", key).where(draw < share[F.col("lang")])

    def to_vectors(columns: list[pa.Array]) -> list[pa.Array]:
        x, letters = vectors(columns[0].to_pylist(), idf)
        return [columns[1], columns[2], pa.array(letters),
                pa.array([v.tobytes() for v in x], pa.binary())]

    vecs = (map_batches(sample.select("text", "lang", "key"), to_vectors,
                        [("lang", "string"), ("key", "long"), ("letters", "long"), ("vec", "binary")])
            .where("letters > 0").dropDuplicates(["lang", "key"]))
    found = (vecs.groupBy("lang").applyInPandas(
        _fit_one, "lang string, cluster int, vec binary, sim array<double>, letters array<long>").collect())
    found.sort(key=lambda r: (r.lang, r.cluster))
    samples = {r.lang: (np.array(r.sim), np.array(r.letters)) for r in found if r.cluster == 0}
    return Centroids([r.lang for r in found],
                     np.stack([np.frombuffer(r.vec, np.float32) for r in found])
                     if found else np.zeros((0, DIM), np.float32),
                     idf, radii(samples) if samples else {})


def held_out(id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def _predict_all(model: Centroids, texts: pa.Array) -> list[tuple[str, float, bool]]:
    texts, out = texts.cast(pa.string()), []
    for lo, hi in pieces_of(texts, SLICE):
        out += model.predict(texts.slice(lo, hi - lo).to_pylist())
    return out


def predict(df: DataFrame, model: Centroids, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``rejected`` of each row's whole text."""
    rows = take(df, id=id, text=text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        got = _predict_all(shared.value, columns[1])
        return [columns[0], pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]

    return map_batches(rows, one, [(id, rows.dtypes[0][1]), ("lang_pred", "string"),
                                   ("score", "double"), ("rejected", "boolean")])


def keep_recognised(df: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text isn't rejected."""
    need(df, text)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        got = _predict_all(shared.value, columns[at])
        keep = pa.array([not rejected for _, _, rejected in got], pa.bool_())
        return [c.filter(keep) for c in columns]

    return map_batches(df, one, df.dtypes)
