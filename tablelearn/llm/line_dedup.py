"""Fuzzy line deduplication by MinHash over character shingles.

Lines (trimmed, lower-cased) are sets of ``CHARS``-character shingles, each
hashed to 40 bits.  Two lines agree in a coordinate with a probability of
their Jaccard similarity, and ``BANDS`` bands of ``ROWS`` coordinates make
candidates: at similarity 0.8 a pair shares one in 99.8 % of cases, at 0.85 in
99.99 %.  There are two kinds of coordinates:

* Lines of ``LONG`` shingles or more: one sorted array of a batch's hashes
  serves all coordinates.  Coordinate j of a line is the first of its hashes
  from the j-th of ``K`` fixed places on the circle of hashes on, which is
  MinHash with cyclic shifts as its permutations.
* Shorter lines: on the circle, one shingle would own many of the places, so
  that coordinates fall together.  Each coordinate is the least of the hashes
  under a multiplier of its own.

Linked lines differ in their number of shingles by a quarter at most, so
lines of up to ``LONG / THRESHOLD`` shingles have the bands of both kinds, and
every pair that can be linked has one kind in common.

Two sketches bound what is worth verifying.  The parities of ``K`` cells of
hashes can't differ in more places than the sets have unshared shingles, so
they rule out no pair of the threshold.  One bit of each of the K coordinates
on the circle does so with a margin (``MARGIN`` standard deviations, with the
variance that the number of shingles gives), between lines of LONG shingles
or more only.  Verification compares the shingle sets exactly and links pairs
of ``THRESHOLD`` or more.  Components of links come from distributed
union-find, and one line of each stays: the first by (id, row, line number).
Rows are numbered once, in a written table, so that rows that share an id, or
have none, keep lines of their own.

Work is kept in proportion to the lines: equal lines are one node, by a
128-bit key.  A bucket's members are first compared with its smallest node
alone.  Only members that are then not in its component are compared with
what is in another component and shares a bucket with them, in the first
bucket that they share, where the bits don't rule it out.  For these members
alone, parities of ``CELLS`` cells a shingle rule out what 256 cells can't tell
from the threshold: most pairs of a large group's lines just below it.

Lines, keys, buckets, links, components and texts are DataFrame work.  The
coordinates and the comparison of sets run in numpy on Arrow batches; a form
with array functions alone was measured and did not meet the limits (README).

Defined cases: blank lines are never compared and stay; null text is one blank
line; a line shorter than a shingle is one shingle; of rows with one id, any
may be the first; a null id comes first; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, need, pieces_of, take
from .components import components
from .shingles import U, _P, mix

CHARS = 8
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
K = 256
CELLS, MOST_CELLS = 4, 1 << 14
MANY_CELLS = 1 << 18       # of some lines, held at once in 2 MB
LONG = 128
MARGIN = 4
SPREAD = 1.25              # the bits' variance is at most 1 + SPREAD * K / shingles that of independent ones
CHUNK_CHARS, CHUNK_LINES = 500_000, 2048
SPACE = " \t\r\x0b\x0c"
BROADCAST_BYTES = 8 << 20
HASH_BITS = 40


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE)))


def shingle_sets(texts: list[str]) -> np.ndarray:
    """Distinct shingles of all lines as sorted numbers: line << 40 | hash."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U(1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    # a polynomial of the CHARS characters from each place on
    m = max(len(cp) - CHARS + 1, 0)
    h = np.zeros(m, np.uint64)
    for k in range(CHARS):
        h *= _P
        h += cp[k:k + m]
    line = np.repeat(np.arange(len(texts)), sizes)[:m]
    whole = np.arange(m) + CHARS <= (first + sizes)[line]
    h, line = h[whole], line[whole]
    # a shorter line is one shingle, filled up with zeros
    short = np.flatnonzero(sizes < CHARS)
    g = np.zeros(len(short), np.uint64)
    pad = np.append(cp, U(0))
    for k in range(CHARS):
        g *= _P
        g += np.where(k < sizes[short], pad[np.minimum(first[short] + k, len(cp))], U(0))
    h, line = np.concatenate([h, g]), np.concatenate([line, short])
    out = np.sort((line.astype(np.uint64) << U(HASH_BITS)) | (mix(h) >> U(64 - HASH_BITS)))
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


# Bands take coordinates that lie apart on the circle.
_BANDS = (np.arange(ROWS)[None, :] * (K // ROWS) + np.arange(BANDS)[:, None] * (K // ROWS // BANDS)).astype(np.int64)


def coordinates(sets: np.ndarray, n: int) -> np.ndarray:
    """n x K: from each place on, the first hash of each line, around the circle.

    The places cut the circle evenly, so the top bits of a hash name its arc.
    """
    line = (sets >> U(HASH_BITS)).astype(np.int64)
    arc = line * K + ((sets >> U(HASH_BITS - K.bit_length() + 1)) & U(K - 1)).astype(np.int64)
    at = np.full(n * K, len(sets))
    new = np.append(True, arc[1:] != arc[:-1])
    at[arc[new]] = np.flatnonzero(new)
    at = np.minimum.accumulate(at.reshape(n, K)[:, ::-1], axis=1)[:, ::-1]
    start = np.searchsorted(line, np.arange(n))
    at = np.where(at == len(sets), start[:, None], at)      # around the circle
    return sets[at] & U((1 << HASH_BITS) - 1)


_OWN = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _P) | U(1)


def own_coordinates(sets: np.ndarray, n: int) -> np.ndarray:
    """n x (BANDS * ROWS): the least product of each line's hashes with each multiplier."""
    start = np.searchsorted((sets >> U(HASH_BITS)).astype(np.int64), np.arange(n))
    h = mix(sets & U((1 << HASH_BITS) - 1))
    return np.stack([np.minimum.reduceat(h * m, start) for m in _OWN], axis=1) if n else np.zeros((0, len(_OWN)), U)


def _band_keys(coordinate: list[np.ndarray], kind: int) -> np.ndarray:
    """The keys of BANDS bands, given their ROWS coordinates."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) + U(kind * BANDS), (len(coordinate[0]), 1))
    for c in coordinate:
        h = mix(h * _P + c)
    return h


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1)).view(np.int64)


def parities(sets: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k: whether an odd number of a line's hashes is in each of k cells."""
    line = (sets >> U(HASH_BITS)).astype(np.int64)
    cell = (mix(sets & U((1 << HASH_BITS) - 1)) % U(k)).astype(np.int64)
    return np.bincount(line * k + cell, minlength=n * k).reshape(n, k) & 1


def many_parities(texts: list[str]) -> list[np.ndarray]:
    """Each line's parities, packed: ``CELLS`` cells a shingle, as a power of two from K to ``MOST_CELLS``.

    The words of half as many cells are the exclusive or of both halves.
    """
    sets, n = shingle_sets(texts), len(texts)
    line = (sets >> U(HASH_BITS)).astype(np.int64)
    wanted = np.clip(CELLS * np.bincount(line, minlength=n), K, MOST_CELLS)
    cells = 1 << np.ceil(np.log2(wanted)).astype(np.int64)
    out = [np.zeros(0, np.int64)] * n
    for k in np.unique(cells).tolist():
        some = np.flatnonzero(cells == k)
        step = MANY_CELLS // k
        for lo in range(0, len(some), step):
            few = some[lo:lo + step]
            at = np.searchsorted(few, line)
            mine = few[np.minimum(at, len(few) - 1)] == line
            rows = parities((at[mine].astype(U) << U(HASH_BITS)) | (sets[mine] & U((1 << HASH_BITS) - 1)), len(few), k)
            for i, row in zip(few.tolist(), _packed(rows), strict=True):
                out[i] = row
    return out


def signs(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each line's bands, and its sketch: parities, bits of the circle (0 if shorter than LONG), shingles."""
    sets, n = shingle_sets(texts), len(texts)
    line = (sets >> U(HASH_BITS)).astype(np.int64)
    size = np.bincount(line, minlength=n)
    long, short = size >= LONG, size * THRESHOLD <= LONG
    sketch = np.zeros((n, 2 * (K // 64) + 1), np.int64)
    sketch[:, :K // 64] = _packed(parities(sets, n))
    sketch[:, -1] = size
    keys, owner = [], []
    for kind, some in enumerate((short, long)):
        if not some.any():
            continue
        at = (np.cumsum(some) - 1).astype(np.uint64)
        mine = sets[some[line]]
        mine = (at[(mine >> U(HASH_BITS)).astype(np.int64)] << U(HASH_BITS)) | (mine & U((1 << HASH_BITS) - 1))
        if kind:
            c = coordinates(mine, some.sum())
            sketch[some, K // 64:-1] = _packed(mix(c) & U(1))
            rows = [c[:, _BANDS[:, r]] for r in range(ROWS)]
        else:
            c = own_coordinates(mine, some.sum())
            rows = [c[:, r * BANDS:(r + 1) * BANDS] for r in range(ROWS)]
        keys.append(_band_keys(rows, kind).view(np.int64))
        owner.append(np.flatnonzero(some))
    if len(keys) == 1:
        return list(keys[0]), sketch
    bands = [np.zeros(0, np.int64)] * n
    for own, rows in zip(owner, keys, strict=True):
        for i, row in zip(own.tolist(), rows, strict=True):
            bands[i] = np.concatenate([bands[i], row]) if len(bands[i]) else row
    return bands, sketch


def _sign(columns: list[pa.Array]) -> list[pa.Array]:
    """Bands and sketches of a batch's lines (none is empty)."""
    out = list(columns[:-1])
    bands, sketches = [], []
    for lo, hi in pieces_of(columns[-1], CHUNK_CHARS, CHUNK_LINES):
        some, rows = signs(columns[-1].slice(lo, hi - lo).to_pylist())
        bands += some
        sketches += list(rows)
    for rows in (bands, sketches):
        ends = np.cumsum([0, *map(len, rows)])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows))))
    return out


def _widen(columns: list[pa.Array]) -> list[pa.Array]:
    """(node, line) to (node, many parities)."""
    words = []
    for lo, hi in pieces_of(columns[1], CHUNK_CHARS, CHUNK_LINES):
        words += many_parities(columns[1].slice(lo, hi - lo).to_pylist())
    ends = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
    values = pa.array(np.concatenate(words) if words else np.zeros(0, np.int64))
    return [columns[0], pa.ListArray.from_arrays(ends, values)]


def _verify(columns: list[pa.Array]) -> list[pa.Array]:
    """(u, v, line of u, line of v) to (u, v, whether the sets reach the threshold)."""
    good = []
    for lo, hi in pieces_of(columns[3], CHUNK_CHARS // 2, CHUNK_LINES):
        n = hi - lo
        texts = columns[2].slice(lo, n).to_pylist() + columns[3].slice(lo, n).to_pylist()
        sets = shingle_sets(texts)
        line = (sets >> U(HASH_BITS)).astype(np.int64)
        size = np.bincount(line, minlength=2 * n)
        pair = ((line % n).astype(np.uint64) << U(HASH_BITS)) | (sets & U((1 << HASH_BITS) - 1))
        both = np.sort(pair)
        again = both[1:][both[1:] == both[:-1]] >> U(HASH_BITS)
        common = np.bincount(again.astype(np.int64), minlength=n)
        good.append(common >= THRESHOLD * (size[:n] + size[n:] - common))
    return [columns[0], columns[1], pa.array(np.concatenate(good) if good else np.zeros(0, bool))]


def _possible() -> Column:
    """Whether the sketches leave the threshold possible."""
    words = K // 64
    differ = lambda first: sum((F.bit_count(F.col("bu")[i].bitwiseXOR(F.col("bv")[i]))
                                for i in range(first, first + words)), F.lit(0))
    nu, nv = F.col("bu")[2 * words], F.col("bv")[2 * words]
    fewer = F.least(nu, nv)
    # sets of the threshold share all but this part of their sizes' sum; the rest allows for rounding
    unshared = (nu + nv) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6
    p = (1 - THRESHOLD) / 2
    limit = K * p + MARGIN * math.sqrt(K * p * (1 - p)) * F.sqrt(1 + SPREAD * K / fewer)
    return ((differ(0) <= unshared) & (F.abs(nu - nv) <= unshared)
            & ((fewer < LONG) | (differ(words) <= limit)))


def _parities_fit() -> Column:
    """Whether the many parities leave the threshold possible, for sizes that ``_possible`` has compared."""
    words = F.least(F.size("wu"), F.size("wv"))
    xor = lambda x, y: x.bitwiseXOR(y)
    # sizes of the threshold differ by a quarter at most, so numbers of cells by a factor of two
    as_few = lambda w: F.when(F.size(w) == words, F.col(w)).otherwise(
        F.zip_with(F.slice(w, 1, words), F.slice(w, words + 1, words), xor))
    differ = F.aggregate(F.zip_with(as_few("wu"), as_few("wv"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0),
                         lambda total, n: total + n)
    both = F.col("bu")[2 * (K // 64)] + F.col("bv")[2 * (K // 64)]
    return differ <= both * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` under the names _0, _1, ... with a number ``row`` of each row, as a written table."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return scratch.write(plain.withColumn("row", F.monotonically_increasing_id()))


def lines(rows: DataFrame) -> DataFrame:
    """id, row, no, line and the 128-bit key (a, b) of each line; null keys for blank lines.

    ``rows`` has id, row and text.
    """
    out = (rows.select("id", "row", F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1))
                       .alias("no", "line"))
           .withColumn("line", normal(F.col("line"))))
    full = F.col("line") != ""
    return out.select("id", "row", "no", "line", F.when(full, F.xxhash64("line")).alias("a"),
                      F.when(full, F.xxhash64(F.lit(1), "line")).alias("b"))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose lines reach the threshold."""
    tu = texts.select(F.col("node").alias("u"), F.col("line").alias("lu"))
    tv = texts.select(F.col("node").alias("v"), F.col("line").alias("lv"))
    both = pairs.join(tv, "v").join(tu, "u").select("u", "v", "lu", "lv")
    return map_batches(both, _verify, [("u", "long"), ("v", "long"), ("good", "boolean")]).where("good").drop("good")


def classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, class_id, class_row, class_no) of each distinct line: the first line of its component."""
    source = lines(rows)
    kind = dict(source.dtypes)["id"]
    signed = map_batches(source.where("a is not null").select("a", "b", "id", "row", "no", "line"), _sign, [
        ("a", "long"), ("b", "long"), ("id", kind), ("row", "long"), ("no", "int"), ("bands", "array<long>"), ("bits", "array<long>")])
    nodes = scratch.write(
        signed.select("a", "b", F.struct("id", "row", "no").alias("at"), "bands", "bits").groupBy("a", "b")
        .agg(F.min("at").alias("at"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id()))
    member = nodes.select("node", F.explode("bands").alias("band"))
    bucket = scratch.write(member.groupBy("band").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    large = bucket.where("n > 2").select("band", "low")
    size = large.count() * 16
    shared = scratch.write(member.join(F.broadcast(large) if size <= BROADCAST_BYTES else large, "band"))
    bits_u = nodes.select(F.col("node").alias("u"), F.col("bits").alias("bu"))
    bits_v = nodes.select(F.col("node").alias("v"), F.col("bits").alias("bv"))
    star = (bucket.where("n = 2").select(F.col("low").alias("u"), F.col("high").alias("v"))
            .union(shared.where("node <> low").select("low", "node")).distinct()
            .join(bits_v, "v").join(bits_u, "u").where(_possible()).select("u", "v"))
    star = scratch.write(star)

    # the lines of nodes that have a candidate, one line of each
    wanted = star.select(F.col("u").alias("node")).union(star.select("v")).union(shared.select("node")).distinct()
    goal = scratch.write(wanted.join(nodes.select("node", "a", "b", "at"), "node"))
    size = goal.count() * 48
    small = F.broadcast(goal) if size <= BROADCAST_BYTES else goal
    same = ((source["a"] == goal["a"]) & (source["b"] == goal["b"]) & (source["no"] == goal["at.no"])
            & (source["row"] == goal["at.row"]))
    texts = scratch.write(source.join(small, same).select("node", "line").dropDuplicates(["node"]))
    scratch.drop(goal)

    links = scratch.write(_links(star, texts))
    parts = components(links, scratch)
    part_of = lambda t, node, name: t.join(
        parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(
        name, F.coalesce(name, node))
    placed = scratch.write(part_of(part_of(shared, "node", "part"), "low", "low_part"))
    apart = placed.where("part <> low_part")
    near = scratch.write(placed.join(apart.select("band").distinct(), "band", "left_semi").where("node <> low"))
    wide = map_batches(texts.join(near.select("node").distinct(), "node", "left_semi").select("node", "line"),
                       _widen, [("node", "long"), ("wide", "array<long>")])
    signs = scratch.write(wide.join(nodes.select("node", "bits", "bands"), "node"))
    stray = apart.join(signs, "node").select(
        "band", F.col("node").alias("u"), F.col("part").alias("pu"), F.col("bits").alias("bu"),
        F.col("wide").alias("wu"), F.col("bands").alias("ku"))
    other = near.join(signs, "node").select(
        "band", F.col("node").alias("v"), F.col("part").alias("pv"), F.col("bits").alias("bv"),
        F.col("wide").alias("wv"), F.col("bands").alias("kv"), (F.col("part") == F.col("low_part")).alias("main"))
    # a pair counts in the first band that it shares
    first = F.get(F.array_intersect("ku", "kv"), F.lit(0)) == stray["band"]
    cross = (stray.join(other, (stray["band"] == other["band"]) & (F.col("pu") != F.col("pv"))
                        & (F.col("main") | (F.col("u") < F.col("v"))) & _possible() & first & _parities_fit())
             .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    more = scratch.write(_links(cross, texts))
    scratch.drop(placed, near, signs, texts, shared, bucket, star)
    whole = components(links.union(more), scratch)
    scratch.drop(links, more)
    labelled = (nodes.select("a", "b", "node", "at").join(whole, "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    first_at = labelled.groupBy("component").agg(F.min("at").alias("first"))
    return labelled.join(first_at, "component").select(
        "a", "b", F.col("first.id").alias("class_id"), F.col("first.row").alias("class_row"),
        F.col("first.no").alias("class_no"))


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """id, row, no, class_id, class_no and kept of each line; a blank line stands for itself."""
    group = classes(rows, scratch)
    out = lines(rows).select("id", "row", "no", "a", "b").join(group, ["a", "b"], "left")
    blank = F.col("a").isNull()
    return out.select(
        "id", "row", "no", F.when(blank, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(blank, F.col("no")).otherwise(F.col("class_no")).alias("class_no"),
        (blank | ((F.col("row") == F.col("class_row")) & (F.col("no") == F.col("class_no")))).alias("kept"))


def line_classes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line: ``id``, ``line_no``, ``class_id``, ``class_line_no``, ``kept``.

    A blank line stands for itself.
    """
    scratch = Scratch(df.sparkSession)
    rows = numbered(take(df, id=id, text=text), scratch).toDF("id", "text", "row")
    return _placed(rows, scratch).select(
        F.col("id").alias(id), F.col("no").alias("line_no"), "class_id",
        F.col("class_no").alias("class_line_no"), "kept")


def dedupe_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the lines of ``text`` that aren't kept taken out.

    The order of lines and all other columns stay; a document may end up empty.
    """
    need(df, id, text)
    scratch = Scratch(df.sparkSession)
    names = df.columns
    rows = numbered(df, scratch)
    key, at = f"_{names.index(id)}", f"_{names.index(text)}"
    gone = (_placed(rows.select(F.col(key).alias("id"), "row", F.col(at).alias("text")), scratch)
            .where("not kept").groupBy("row").agg(F.collect_set("no").alias("_gone")))
    joined = rows.join(gone, "row", "left")
    left = F.array_join(F.filter(F.split(F.col(at), "\n", -1),
                                 lambda _, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), F.col(at)).otherwise(left).alias(at)
    return joined.select(*[new if f"_{i}" == at else F.col(f"_{i}") for i in range(len(names))]).toDF(*names)
