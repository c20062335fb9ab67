"""Token ids as files of compressed planes, with a chunk index.

Documents are encoded in ascending order of their id, each followed by an end
id, and the ids make one long stream.  The stream is cut into shards (one for
each partition of a range partitioning by id) and each shard into chunks of
``BLOCK`` ids; only a shard's last chunk is shorter.  A chunk's ids are taken
as little-endian 32-bit integers and transposed into planes: plane j holds
byte j (or bit j) of every id.  A plane holds one kind of digit, and the upper
ones are constant, so each is compressed by itself with zstandard.

A written folder holds two tables:

* ``chunks``: shard, chunk, number of ids, the chunk's bytes (``pack``), and
  which documents its ids belong to.
* ``index``: for every chunk its first id's place in the whole stream, its
  number of ids and bytes.  ``read_range`` finds the chunks of a stretch with
  it and decodes no others.

Parquet is the container, uncompressed: Spark commits whole files only, in
any store, so a lost executor leaves no half shard behind, and row groups are
skipped by the chunks' numbers.

Encoding: in the byte-level pre-tokenisation white space ends a piece, one
space goes with the word after it, and pieces don't influence each other.  So
a text is cut into words and white space, words come from bounded caches, and
the words that they lack are encoded by the library, many in one call.  A text
that holds the string of an added token is encoded whole.

Nothing but one row per shard (the shards' lengths) is gathered or broadcast.

Defined cases: a null text is empty; a null id comes first; rows that share an
id are documents of their own, in the order of a hash of their text; a text
longer than a chunk goes on in the next ones; an empty table gives an empty
stream, and reading it gives no rows; columns are found by exact name.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import Scratch, bound_batches, map_batches, pieces_of, take

BLOCK = 1 << 16
END = 2
LEVEL = 1
MAGIC = b"IDPL"
KINDS = ("byte", "bit")
WORDS = 1_000_000          # of the cache of a Python worker
SLICE = 4 << 20            # bytes of text encoded at a time
LONG_WORD = 256            # longer words aren't kept
CHUNKS = 16                # decoded at a time


# -- planes ---------------------------------------------------------------

def pack(ids: np.ndarray, kind: str = "byte") -> bytes:
    """A chunk's bytes: magic, kind, number of planes, number of ids, planes' sizes, planes."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1)
    else:
        planes = cells.T
    press = zstandard.ZstdCompressor(level=LEVEL)
    frames = [press.compress(np.ascontiguousarray(p)) for p in planes]
    return b"".join([struct.pack("<4sBBI", MAGIC, KINDS.index(kind), len(frames), len(ids)),
                     struct.pack(f"<{len(frames)}I", *map(len, frames)), *frames])


def unpack(blob: bytes) -> np.ndarray:
    """The ids of a chunk's bytes."""
    magic, kind, planes, n = struct.unpack_from("<4sBBI", blob)
    if magic != MAGIC:
        raise ValueError("not a chunk of ids")
    at = struct.calcsize("<4sBBI")
    sizes = struct.unpack_from(f"<{planes}I", blob, at)
    at, rows = at + 4 * planes, []
    width = (n + 7) // 8 if KINDS[kind] == "bit" else n
    loose = zstandard.ZstdDecompressor()
    for size in sizes:
        rows.append(np.frombuffer(loose.decompress(blob[at:at + size], max_output_size=max(width, 1)), np.uint8))
        at += size
    cells = np.stack(rows)
    if KINDS[kind] == "bit":
        cells = np.packbits(np.unpackbits(cells, axis=1, count=n).T, axis=1, bitorder="little")
        return np.ascontiguousarray(cells).view("<u4").ravel()
    return np.ascontiguousarray(cells.T).view("<u4").ravel()


# -- encoding -------------------------------------------------------------

#: White space as the pre-tokenizer has it, as a character class (fixed values of Unicode's White_Space).
WHITE = "\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: More than single spaces and line ends inside a text.
ODD = f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$|[{WHITE.replace(' ', '').replace('-', '', 1)}]".replace(
    "\\t\\r", "\\t\\x0b-\\r")
_RUNS = re.compile(f"[{WHITE}]+|[^{WHITE}]+")
_IS_WHITE = re.compile(f"[{WHITE}]")
MARKS = frozenset(".,;:!?)")
LINE = "\n"                # before a word that no space precedes


class Encoder:
    """Ids of texts by the tokenizers library, with a cache of words.

    The tokenizer is byte-level without a prefix space and without dropout;
    any other is used on whole texts.
    """

    def __init__(self, model: str, special_as_text: bool = False, words: int = WORDS):
        from tokenizers import Tokenizer
        import json

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = special_as_text
        told = json.loads(model)
        shape = told.get("pre_tokenizer") or {}
        self.by_word = (shape.get("type") == "ByteLevel" and not shape.get("add_prefix_space")
                        and shape.get("use_regex", True) and not told.get("normalizer")
                        and not told["model"].get("dropout"))
        self.special = [] if special_as_text else [t["content"] for t in told.get("added_tokens", [])]
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)       # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.words, self.cache, self.line = words, {}, self.whole(LINE)
        self.by_word &= len(self.line) == 4

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words (no white space in them) that follow a space."""
        found = {}
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
            at = 4 * np.flatnonzero(self.starts[ids])
            if len(at) != len(part):
                raise ValueError("words and their first ids don't agree")
            raw = ids.tobytes()
            found.update(zip(part, map(raw.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(raw)]))))
        return found

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space, or of a line end and what follows it."""
        cache = self.cache
        found = list(map(cache.get, words))
        missing = set(compress(words, map(is_, found, repeat(None))))
        if not missing:
            return found
        # letters and a mark at their end are pieces of their own
        marked = {w for w in missing if w[-1] in MARKS and w[:-1].isalpha()}
        lines = {w for w in missing if w[0] == LINE}
        bases = {w[:-1] for w in marked} - missing
        new = self.learn([*(missing - marked - lines), *(b for b in bases if b not in cache)])
        marks = {m: self.whole(m) for m in MARKS} if marked else {}
        for w in marked:
            new[w] = (new.get(w[:-1]) or cache[w[:-1]]) + marks[w[-1]]
        new.update((w, self.line + self.whole(w[1:])) for w in lines)
        found = [x or new[w] for x, w in zip(found, words)]
        if len(cache) + len(new) > self.words:
            cache.clear()
        cache.update((w, ids) for w, ids in new.items() if len(w) <= LONG_WORD)
        return found

    def runs(self, text: str) -> tuple[list[str], list[bool]]:
        """A text as words and white space, and which of the words follow a space that is theirs."""
        parts, own = [], []
        for run in _RUNS.findall(text):
            if not _IS_WHITE.match(run):
                parts.append(run)
                own.append(bool(len(parts) > 1 and parts[-2] == " "))
                if own[-1]:
                    del parts[-2], own[-2]
            else:                    # all but the last are one piece, unless the text ends here
                parts += [run[:-1], run[-1]] if len(run) > 1 else [run]
                own += [False] * (len(parts) - len(own))
        if len(parts) > 1 and own and _IS_WHITE.match(parts[-1]) and _IS_WHITE.match(parts[-2]):
            parts[-2:], own[-2:] = [parts[-2] + parts[-1]], [False]
        return parts, own

    def odd(self, text: str) -> np.ndarray:
        """Ids of a text with any white space, or an added token's string, in it."""
        if any(s in text for s in self.special):
            return np.frombuffer(self.whole(text), "<u4")
        parts, own = self.runs(text)
        found = self.look_up([w if o else LINE + w for w, o in zip(parts, own)])
        return np.frombuffer(b"".join([x if o else x[4:] for x, o in zip(found, own)]), "<u4")

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end``, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return _stream([np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist()], end)
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = texts.filter(pc.invert(odd))
        marked = pc.binary_join_element_wise(LINE, pc.replace_substring(plain, "\n", " " + LINE), "")
        words = pc.split_pattern(marked, " ")
        known = words.flatten().dictionary_encode()
        ids = self.look_up(known.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        place = np.cumsum(size, dtype=np.int32) - size
        pick = known.indices.to_numpy()
        size = size[pick]
        at = np.cumsum(size, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        flat = flat[np.arange(at[-1] if len(at) else 0, dtype=np.int32) + np.repeat(place[pick] - at + size, size)]
        ends = np.concatenate([[0], at])[np.cumsum(pc.list_value_length(words).to_numpy())]
        out = np.roll(flat, -1)                    # a text's first line end gives its place to ``end``
        out[ends - 1] = end
        counts = np.diff(ends, prepend=0)
        if len(plain) == len(texts):
            return out, counts
        rest = iter(np.split(out, ends[:-1]) if len(ends) else [])
        return _stream([self.odd(t) if o else next(rest)[:-1]
                        for t, o in zip(texts.to_pylist(), odd.to_pylist())], end)


def _stream(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    mark = np.array([end], "<u4")
    return (np.concatenate([y for x in ids for y in (x, mark)] or [mark[:0]]),
            np.array([len(x) + 1 for x in ids], np.int64))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: str, special_as_text: bool) -> Encoder:
    """This worker's encoder; kept for its later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (zlib.crc32(model.encode()), len(model), special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, special_as_text)
    return _ENCODERS[key]


# -- writing --------------------------------------------------------------

class Cutter:
    """Cuts a shard's stream of documents into chunks."""

    def __init__(self, block: int, kind: str, id_type: pa.DataType):
        self.block, self.kind = block, kind
        self.ids = np.zeros(0, "<u4")                  # not written yet
        self.chunk = self.end = self.docs = 0          # next chunk; ids and documents so far
        self.names = pa.array([], id_type)             # of documents that the unwritten ids belong to
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        self.ids = np.concatenate([self.ids, ids])
        ends = self.end + np.cumsum(counts)
        self.names = pa.concat_arrays([self.names, names])
        self.start = np.concatenate([self.start, ends - counts])
        self.count = np.concatenate([self.count, counts])
        self.docs += len(counts)
        self.end = int(ends[-1]) if len(ends) else self.end
        at = 0
        while len(self.ids) - at >= self.block:
            yield self.cut(self.ids[at:at + self.block])
            at += self.block
        self.ids = self.ids[at:]

    def rest(self) -> Iterator[tuple]:
        if len(self.ids):
            yield self.cut(self.ids)

    def cut(self, ids: np.ndarray) -> tuple:
        """(chunk, its first id's place, number of ids, bytes, number of its first document, names, starts, counts)."""
        lo = self.chunk * self.block
        hi = lo + len(ids)
        inside = int(np.searchsorted(self.start, hi))
        row = (self.chunk, lo, len(ids), pack(ids, self.kind), self.docs - len(self.start),
               self.names[:inside], self.start[:inside], self.count[:inside])
        done = int(np.searchsorted(self.start + self.count, hi, "right"))
        self.names, self.start, self.count = self.names[done:], self.start[done:], self.count[done:]
        self.chunk += 1
        return row


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text",
                 end: int = END, block: int = BLOCK, planes: str = "byte", special_as_text: bool = False) -> None:
    """Write the ids of ``docs`` as chunks and their index under ``path``.

    ``tokenizer`` is a file of the tokenizers library, read on the driver.
    """
    if planes not in KINDS or block < 1:
        raise ValueError(f"planes must be one of {KINDS}, block at least 1")
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    docs = take(docs, id=id, text=text)
    kind = docs.schema["id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["id", "_hash", "_row"]                    # the last one spreads equal rows
    ranged = (docs.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
              .repartitionByRange(n, *keys).sortWithinPartitions(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, cutter = TaskContext.get().partitionId(), encoder(model.value, special_as_text), None

        def row(c: tuple) -> pa.RecordBatch:
            chunk, place, m, blob, first, names, start, count = c
            docs = pa.StructArray.from_arrays(
                [pa.array(np.arange(first, first + len(start))), names, pa.array(start), pa.array(count)],
                ["no", "id", "start", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([place], pa.int64()),
                 pa.array([m], pa.int32()), pa.array([blob], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)],
                names=["shard", "chunk", "first", "n", "blob", "docs"])

        for b in batches:
            names, texts = b.columns
            cutter = cutter or Cutter(block, planes, names.type)
            for lo, hi in pieces_of(texts, SLICE):
                yield from map(row, cutter.add(names[lo:hi], *enc.encode(texts[lo:hi], end)))
        if cutter:
            yield from map(row, cutter.rest())

    schema = ("shard int, chunk bigint, first bigint, n int, blob binary, "
              f"docs array<struct<no: bigint, id: {kind}, start: bigint, n: bigint>>")
    ranged.select("id", "text").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    lengths = chunks.groupBy("shard").agg(F.sum("n").alias("_n"))
    starts = spark.createDataFrame(_starts(lengths.collect()), "shard int, base bigint")    # a row per partition
    (chunks.join(F.broadcast(starts), "shard")
     .select("shard", "chunk", (F.col("base") + F.col("first")).alias("start"), "n",
             F.octet_length("blob").alias("n_bytes"), F.size("docs").alias("n_docs"))
     .write.parquet(f"{path}/index"))


def _starts(lengths: list) -> list[tuple[int, int]]:
    out, at = [], 0
    for shard, n in sorted(tuple(r) for r in lengths):
        out.append((shard, at))
        at += n
    return out


# -- reading --------------------------------------------------------------

def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids array<bigint>) of the stretches of the ids from place ``first`` up to ``last``.

    The index names the chunks; only those are decoded.
    """
    index = spark.read.parquet(f"{path}/index").where(
        (F.col("start") < last) & (F.col("start") + F.col("n") > first)).select("shard", "chunk", "start")
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "blob")

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        at, ids = [], []
        for start, blob in zip(*[c.to_pylist() for c in columns]):
            x = unpack(blob)
            lo, hi = max(first - start, 0), min(last - start, len(x))
            at.append(start + lo)
            ids.append(x[lo:hi].astype(np.int64))
        return [pa.array(at, pa.int64()), pa.array(ids, pa.list_(pa.int64()))]

    return map_batches(chunks.join(index, ["shard", "chunk"]).select("start", "blob"), run,
                       [("start", "bigint"), ("ids", "array<bigint>")])


def joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of a whole from (crc32, number of bytes) of its parts in order.

    How a crc32 changes as bytes follow is a linear map that depends on their
    number alone, so that zeros show it.
    """
    total = 0
    for crc, n in parts:
        zeros = bytes(n)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def _parts(columns: list[pa.Array]) -> list[pa.Array]:
    """shard, no, start, n, place of the part, its length and crc32, id: a row per document in a chunk."""
    shard, first, blob, docs = columns
    rows, names = [[] for _ in range(7)], []
    for i in range(len(shard)):
        ids, at, d = unpack(blob[i].as_py()), first[i].as_py(), docs[i].values
        start, n = (d.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
        lo, hi = np.maximum(start, at), np.minimum(start + n, at + len(ids))
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((lo - at).tolist(), (hi - at).tolist())]
        for row, values in zip(rows, (np.full(len(n), shard[i].as_py()), d.field("no").to_numpy(), start, n, lo,
                                      hi - lo, np.array(crc, np.int64))):
            row.append(values)
        names.append(d.field("id"))
    return [*[pa.array(np.concatenate(r), t) for r, t in zip(rows, (pa.int32(), *[pa.int64()] * 6))],
            pa.concat_arrays(names)]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the written files.

    Each chunk is decoded once and gives a row for each document that it holds
    ids of.  Only documents that go over more than one chunk are shuffled.
    """
    scratch = Scratch(spark)
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    parts = scratch.write(map_batches(chunks.select("shard", "first", "blob", "docs"), _parts, [
        ("shard", "int"), ("no", "bigint"), ("start", "bigint"), ("n", "bigint"), ("lo", "bigint"),
        ("k", "bigint"), ("crc", "bigint"), ("id", kind)], rows=CHUNKS))
    whole = parts.where("k = n").select("shard", "id", "start", "n", "crc")
    cut = parts.where("k < n").groupBy("shard", "no", "start", "n").agg(
        F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("lo", "crc", "k"))).alias("p"))

    def join(columns: list[pa.Array]) -> list[pa.Array]:
        crc = [joined([(x["crc"], 4 * x["k"]) for x in p]) for p in columns[-1].to_pylist()]
        return [*columns[:-1], pa.array(crc, pa.int64())]

    cut = map_batches(cut.select("shard", "id", "start", "n", "p"), join, [
        ("shard", "int"), ("id", kind), ("start", "bigint"), ("n", "bigint"), ("crc", "bigint")])
    base = (spark.read.parquet(f"{path}/index").where("chunk = 0")
            .select(F.col("shard").alias("s"), F.col("start").alias("base")))      # a row per shard
    return (whole.union(cut).join(F.broadcast(base), F.col("shard") == F.col("s"))
            .select("id", (F.col("base") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"),
                    F.col("crc").alias("ids_crc32")))
