"""Source divergence audit: how far the term shares of sources are apart.

Terms are runs of letters (A-Z lower-cased) and of everything beyond ASCII.  A
language keeps the terms that occur in at least ``LEAST_DOCS`` of its
documents.  A group is a source within a language; with V kept terms and N
occurrences of them in a group, a term with c occurrences there has the share
``1 + floor(SCALE * (c + 1) / (N + V))``, a whole number.  The divergence of
share p from share q at a term is ``floor((p - q)^2 / q)``.

``divergences`` compares every source with every other one of its language,
over all kept terms.  It works on run-length columns:

1. Documents are counted in slices, each slice's counts by (language, source,
   term) summed before the shuffle.
2. The vocabulary of a language is reordered so that terms with equal counts
   stand together: by total, then by the counts of the sources, across all
   partitions (a range partitioning).
3. Blocks of terms in that order become one column for each source, as runs of
   equal counts; a source without a term in the block is one run of zeros.
4. For each pair of sources the boundaries of their runs are intersected, and
   a stretch's divergence, taken once, is multiplied by its length.  Blocks
   add up.

``leading_terms`` gives the terms whose share in a source exceeds that in its
whole language most.

A block has at most ``ENTRIES`` counts, a term at most one count per source,
and a language's row at most one total per source; the pairs of sources are
the result itself.  Nothing is gathered on the driver.

All arithmetic is exact in 64 bits as long as N + V is under 9e15.

Defined cases: a null text, language or source reads as ''; a group without a
kept term takes part with counts of zero; a language without kept terms has
divergences of zero and no leading terms; repeated rows count as often as they
stand there; ties go by the UTF-8 order of the item; an empty table gives an
empty result; columns are found by exact name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Scratch, bound_batches, map_batches, pieces_of, take

LEAST_DOCS = 3
SCALE_STEPS = 3                 # the scale is 1000 to this power, multiplied step by step
SCALE = 1000 ** SCALE_STEPS
TOP = 200
SLICE = 4 << 20                 # bytes of text counted at a time; a worker holds some fifteen times as much
ENTRIES = 1 << 18               # counts in a block of the vocabulary
#: Letters as they are or lower-cased, everything else of ASCII as a space.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


# -- counts ---------------------------------------------------------------

def split_terms(texts: pa.Array, signs: bytes = SIGNS) -> pa.ListArray:
    """The terms of each text (no null), with empty strings between adjoining separators.

    ``signs`` says for every byte what it reads as; that of a separator is a space.
    """
    texts = texts.cast(pa.large_string())
    offsets = pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset)
    shown = bytes(texts.buffers()[2] or b"").translate(signs)
    return pc.split_pattern(pa.LargeStringArray.from_buffers(
        len(texts), offsets.buffers()[1], pa.py_buffer(shown), offset=texts.offset), " ")


def count_slice(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a slice of documents, and (lang, source, null, 0, 0) of each group."""
    texts = pc.fill_null(texts, "")
    langs, sources = (pc.fill_null(x, "").dictionary_encode() for x in (lang, source))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    groups, group = np.unique(group, return_inverse=True)
    lists = split_terms(texts)
    terms = lists.flatten().dictionary_encode()
    codes, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    blank = pc.index(names, "").as_py()
    if blank >= 0:
        doc, codes = doc[codes != blank], codes[codes != blank]
    order = np.argsort(group, kind="stable")                  # documents of a group side by side
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key = codes * len(order) + place[doc]                     # by term, then by group and document
    key.sort()
    fresh = np.diff(key, prepend=-1) != 0                     # first of a term's in a document
    code, spot = np.divmod(key, max(len(order), 1))
    cell = code * len(groups) + group[order][spot]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    n = np.diff(starts, append=len(cell))
    docs = np.add.reduceat(fresh, starts, dtype=np.int64) if len(starts) else n
    code, g = np.divmod(cell[starts], max(len(groups), 1))
    code = pa.array(np.concatenate([code, np.zeros(len(groups), np.int64)]),
                    mask=np.concatenate([np.zeros(len(code), bool), np.ones(len(groups), bool)]))
    g = np.concatenate([groups[g], groups])
    zeros = np.zeros(len(groups), np.int64)
    l, s = np.divmod(g, max(len(sources.dictionary), 1))
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(l)), sources.dictionary.take(pa.array(s)), names.take(code).cast(pa.string()),
         pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros]))],
        names=["lang", "source", "term", "n", "docs"])


def vectors(docs: DataFrame, text: str, lang: str, source: str, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, items array<struct<source, n>>) of kept terms; a null term lists all sources."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    docs = take(docs, lang=lang, source=source, text=text)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            out = count_slice(*[pa.concat_arrays(c) for c in zip(*held)])
            for lo in range(0, out.num_rows, 100_000):
                yield out.slice(lo, 100_000)

        for b in batches:
            for lo, hi in pieces_of(b.columns[2], SLICE):
                part = b.slice(lo, hi - lo)
                add = pc.sum(pc.binary_length(part.columns[2])).as_py() or 0
                if held and size + add > SLICE:
                    yield from counted()
                    held, size = [], 0
                held.append(part.columns)
                size += add
        if held:
            yield from counted()

    counts = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (counts.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                 F.sort_array(F.collect_list(F.struct("source", "n"))).alias("items"))
            .where((F.col("docs") >= least) | F.col("term").isNull())
            .select("lang", "term", "total", "items"))


def totals(kept: DataFrame) -> DataFrame:
    """(lang, v, lang_n, sources array<struct<source, n>>): a row for each language, all its sources in order."""
    per = (kept.select("lang", F.inline("items")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
           .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")))
    whole = kept.groupBy("lang").agg(F.count("term").alias("v"), F.sum("total").alias("lang_n"))
    return whole.join(per.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).drop("l")


# -- exact shares and divergences -----------------------------------------

def share(c: np.ndarray, n: int, v: int) -> np.ndarray:
    """Shares of counts c in a group with n occurrences of v kept terms."""
    rest, out = np.asarray(c, np.int64) + 1, np.int64(0)
    for _ in range(SCALE_STEPS):
        whole, rest = np.divmod(rest * 1000, n + v)
        out = out * 1000 + whole
    return out + 1


def share_column(c: Column, n: Column, v: Column) -> Column:
    """As ``share``, of columns."""
    rest, out, d = c + 1, F.lit(0).cast("bigint"), n + v
    for _ in range(SCALE_STEPS):
        out = out * 1000 + F.call_function("div", rest * 1000, d)
        rest = (rest * 1000) % d
    return out + 1


def divergence(p, q):
    """floor((p - q)^2 / q) of whole numbers."""
    return (p - q) * (p - q) // q


# -- run-length columns ---------------------------------------------------

def run_ends(place: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column with ``value`` at ``place`` (ascending) and zeros elsewhere."""
    first = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(value, prepend=-1) != 0))
    last = np.append(first, len(place))[1:] - 1
    ends = np.stack([place[first], place[last] + 1], axis=1).ravel()
    counts = np.stack([np.zeros(len(first), np.int64), value[first]], axis=1).ravel()
    ends, counts = np.append(ends, size), np.append(counts, 0)
    real = np.diff(ends, prepend=0) > 0
    return ends[real], counts[real]


def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of terms in their order as run-length columns: (lang, size, source, runs, ends, counts)."""
    held, lang, entries = [], None, 0

    def block() -> pa.RecordBatch:
        items = pa.concat_arrays(held)
        terms, flat = len(items), items.flatten()
        place = np.repeat(np.arange(terms), pc.list_value_length(items).to_numpy())
        names = flat.field("source").dictionary_encode()
        which, value = names.indices.to_numpy(), flat.field("n").to_numpy()
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(names.dictionary) + 1))
        columns = [run_ends(place[order[a:b]], value[order[a:b]], terms) for a, b in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([terms]), pa.array([names.dictionary.to_pylist()]),
             pa.array([[len(e) for e, _ in columns]], pa.list_(pa.int64())),
             pa.array([np.concatenate([e for e, _ in columns])], pa.list_(pa.int64())),
             pa.array([np.concatenate([c for _, c in columns])], pa.list_(pa.int64()))],
            names=["lang", "size", "source", "runs", "ends", "counts"])

    for b in batches:
        langs, items = b.columns
        codes = langs.dictionary_encode()
        cuts = [0, *(np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1).tolist(), len(langs)]
        for a, z in zip(cuts, cuts[1:]):
            sizes = np.cumsum(pc.list_value_length(items[a:z]).to_numpy())
            lo, name = a, langs[a].as_py()
            while lo < z:
                if held and (name != lang or entries >= ENTRIES):
                    yield block()
                    held, entries = [], 0
                lang, done = name, sizes[lo - a - 1] if lo > a else 0
                hi = min(z, max(lo + 1, a + int(np.searchsorted(sizes, done + ENTRIES - entries, "right"))))
                held.append(items[lo:hi])
                entries += int(sizes[hi - a - 1] - done)
                lo = hi
    if held:
        yield block()


def compare_runs(columns: list[pa.Array]) -> list[pa.Array]:
    """(lang, source, item, value) of all pairs of a language's sources in each block."""
    out = [[], [], [], []]
    for lang, size, held, runs, ends, counts, v, sources in zip(*[c.to_pylist() for c in columns]):
        at = np.cumsum([0, *runs])
        ends, counts = np.array(ends, np.int64), np.array(counts, np.int64)
        mine = {s: (ends[a:b], counts[a:b]) for s, a, b in zip(held, at, at[1:])}
        none = (np.array([size], np.int64), np.zeros(1, np.int64))
        shares = []
        for s in sources:
            e, c = mine.get(s["source"], none)
            shares.append((s["source"], e, share(c, s["n"], v)))
        for i, (a, a_ends, a_share) in enumerate(shares):
            for b, b_ends, b_share in shares[:i]:
                cut = np.union1d(a_ends, b_ends)
                p, q = a_share[np.searchsorted(a_ends, cut)], b_share[np.searchsorted(b_ends, cut)]
                length = np.diff(cut, prepend=0)
                for column, values in zip(out, ((lang, lang), (a, b), (b, a), (
                        int((divergence(p, q) * length).sum()), int((divergence(q, p) * length).sum())))):
                    column.extend(values)
    return [*[pa.array(c, pa.string()) for c in out[:3]], pa.array(out[3], pa.int64())]


def divergences(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source against each other one of its language."""
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lang", "total", "items", "term"]
    ordered = kept.where(F.col("term").isNotNull()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    blocks = ordered.select("lang", "items").mapInArrow(
        encode_runs, "lang string, size bigint, source array<string>, runs array<bigint>, "
                     "ends array<bigint>, counts array<bigint>")
    own = sums.select(F.col("lang").alias("l"), "v", "sources")
    found = map_batches(
        blocks.join(own, F.col("lang") == F.col("l")).drop("l"), compare_runs,
        [("lang", "string"), ("source", "string"), ("item", "string"), ("value", "bigint")], rows=1)
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = (sums.where("v = 0").select("lang", F.explode("sources.source").alias("source"), "sources")
            .select("lang", "source", F.explode("sources.source").alias("item"), F.lit(0).cast("bigint").alias("value"))
            .where("source <> item"))
    return found.union(bare)


def leading_terms(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms with a larger share in a source than in its language."""
    whole = sums.select(F.col("lang").alias("l"), "v", "lang_n", F.inline("sources"))
    whole = whole.select("l", "v", "lang_n", F.col("source").alias("s"), F.col("n").alias("group_n"))
    each = kept.where(F.col("term").isNotNull()).select("lang", F.col("term").alias("item"), "total", F.inline("items"))
    each = each.join(whole, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    each = each.withColumns({"p": share_column(F.col("n"), F.col("group_n"), F.col("v")),
                             "q": share_column(F.col("total"), F.col("lang_n"), F.col("v"))})
    return each.where("p > q").select(
        "lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          top: int = TOP, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): sources by divergence, and each source's ``top`` terms."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(vectors(docs, text, lang, source, least))
    sums = scratch.write(totals(kept))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = divergences(kept, sums).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = leading_terms(kept, sums).withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(terms)
