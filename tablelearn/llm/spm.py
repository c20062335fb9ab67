"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text gets a leading space mark, spaces become marks, and it falls into
words that no piece of the vocabulary can cross (no piece holds a mark after
another character, and characters outside the vocabulary never merge).  The
distinct words that a worker hasn't met yet are encoded together: their
symbols lie in flat numpy arrays, each round finds the best pair rank of each
word, merges its occurrences from the left at once and compacts the arrays,
until no pair remains.

A round merges all occurrences of a word's best rank only if every pair that
these merges make ranks later, so that the order of single merges can't
matter; otherwise it merges the leftmost one alone.  The ids are therefore
those of merging one pair at a time.  A word that needs many such single
merges (a run of thousands of spaces, say) is finished by a heap of pairs in
that same order, so that the cost of a word stays near its length.

Defined cases: null text counts as empty and has no ids; control and byte
pieces written out in a text are ordinary characters; characters outside the
vocabulary become byte pieces; extra columns pass through, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, need, pieces_of, take

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHE_WORDS = 120_000      # words a worker remembers; a fuller cache starts anew
CHUNK_CHARS = 600_000      # text that a worker splits into words at a time
NO_PAIR = np.int64(2**62)
PATIENCE = 64              # rounds with a single merge after which a word goes to the heap


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        s += 7
        if c < 128:
            return x, i


def _fields(b: bytes):
    """(field number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        elif kind == 5:
            v, i = struct.unpack("<f", b[i:i + 4])[0], i + 4
        else:
            v, i = b[i:i + 8], i + 8
        yield key >> 3, v


class _Codes(dict):
    """Numbers strings in the order met; ``fresh`` lists those not yet encoded."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class PieceModel:
    """Vocabulary, pair table and word cache of one model file."""

    def __init__(self, data: bytes):
        pieces, norm = [], {}
        for f, v in _fields(data):
            if f == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), d.get(2, 0.0), d.get(3, NORMAL)))
            elif f == 3:
                norm = dict(_fields(v))
        if norm.get(1) != b"identity" or norm.get(4, 1) or not norm.get(3, 1):
            raise ValueError("only models without normalisation and with a dummy prefix")
        if any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.n = len(pieces)
        self.by_name = {s: i for i, (s, _, t) in enumerate(pieces) if t == NORMAL}
        if any(MARK in s.lstrip(MARK) for s in self.by_name):
            raise ValueError("a piece holds a space mark after another character")
        # Rank of a piece: the order of its score, equal for equal scores.
        scores = sorted({-s for s, i in ((pieces[i][1], i) for i in self.by_name.values())})
        order = {s: r for r, s in enumerate(scores)}
        self.symbols = dict(self.by_name)         # every string that can be a symbol
        for s in self.by_name:
            for c in s:
                self.symbols.setdefault(c, self.n + len(self.symbols))
        self.width = max(self.symbols.values()) + 2
        self.other = self.width - 1               # a character that never merges
        keys, ranks, made = [], [], []
        for s, i in self.by_name.items():
            for k in range(1, len(s)):
                a, b = self.symbols.get(s[:k]), self.symbols.get(s[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(order[-pieces[i][1]])
                    made.append(i)
        self.ranks, self.made = np.array(ranks, np.int64), np.array(made, np.int64)
        self._hash_pairs(np.array(keys, np.int64))
        self.byte_id = np.zeros(256, np.int64)
        raw = []
        for i, (s, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_id[int(s[3:5], 16)] = i
                raw.append(bytes([int(s[3:5], 16)]))
            elif t == UNKNOWN:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(b"" if t == CONTROL else s.replace(MARK, " ").encode())
        self.marked = np.array([s.startswith(MARK) and t == NORMAL for s, _, t in pieces])
        self.control = np.array([t == CONTROL for _, _, t in pieces])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.splitter = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.forget()

    def forget(self) -> None:
        self.cache = _Codes()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    # -- pairs ---------------------------------------------------------------

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair key to its place in the pair lists."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = (1 << bits) - 1
        self.slot_key = np.full(self.slots + 1, -1, np.int64)
        self.slot_place = np.full(self.slots + 1, -1, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slot_key[at] < 0
            slot, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[slot >= 0]
            self.slot_key[at[one]] = keys[left[one]]
            self.slot_place[at[one]] = left[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair lists, -1 if it makes no piece."""
        k = a * self.width + b
        at = self._slot(k)
        found = self.slot_key[at]
        out = np.where(found == k, self.slot_place[at], -1)
        open_ = np.flatnonzero((found != k) & (found >= 0))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & self.slots
            want = k[open_]
            found = self.slot_key[at]
            out[open_] = np.where(found == want, self.slot_place[at], -1)
            more = (found != want) & (found >= 0)
            open_, at = open_[more], at[more]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.ranks[at], NO_PAIR)

    def merge(self, sym: np.ndarray, word: np.ndarray, n_words: int):
        """Merge rounds over flat symbols; ``word`` is non-decreasing.

        Returns the final symbols and their words.
        """
        done_sym, done_word = [], []
        singles = np.zeros(n_words, np.int64)
        inner = np.append(word[1:] == word[:-1], False)
        at = np.where(inner, self.pair(sym, np.append(sym[1:], self.other)), -1)
        while len(sym):
            rank = self._rank(at)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            runs = np.diff(np.append(first, len(sym)))
            best_of = np.repeat(best, runs)
            live = best_of < NO_PAIR
            if not live.all():                    # words without a pair are done
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, at, rank, best_of = (
                    x[live] for x in (sym, word, at, rank, best_of))
                if not len(sym):
                    break
            hit = rank == best_of
            # of overlapping occurrences the 1st, 3rd, ... of each stretch
            i = np.flatnonzero(hit)
            begins = np.append(True, np.diff(i) > 1)
            nth = np.arange(len(i)) - np.repeat(np.flatnonzero(begins), np.diff(
                np.append(np.flatnonzero(begins), len(i))))
            i = i[nth % 2 == 0]
            new = self.made[at[i]]
            # what stands left and right of each merged pair, merged itself if it is merged too
            left_same = np.append(False, (np.diff(i) == 2) & (word[i[1:]] == word[i[:-1]]))
            has_left = (i > 0) & (word[np.maximum(i - 1, 0)] == word[i])
            left = np.where(left_same, np.append(new[:1], new[:-1]), sym[np.maximum(i - 1, 0)])
            j = np.minimum(i + 2, len(sym) - 1)
            has_right = (i + 2 < len(sym)) & (word[j] == word[i])
            lo = best_of[i]
            unsafe = (has_left & (self._rank(self.pair(left, new)) <= lo)) | (
                has_right & (self._rank(self.pair(new, sym[j])) <= lo))
            if unsafe.any():
                single = np.zeros(n_words, bool)
                single[word[i[unsafe]]] = True
                singles += single
                lead = np.append(True, word[i[1:]] != word[i[:-1]])
                keep = lead | ~single[word[i]]
                i, new = i[keep], new[keep]
            sym[i] = new
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, word, at = sym[stay], word[stay], at[stay]
            # only pairs with a merged symbol are new
            here = i - np.arange(1, len(i) + 1) + 1
            redo = np.concatenate([here, here[here > 0] - 1])
            right = np.minimum(redo + 1, len(sym) - 1)
            inner = (redo + 1 < len(sym)) & (word[right] == word[redo])
            at[redo] = np.where(inner, self.pair(sym[redo], sym[right]), -1)
            late = np.flatnonzero(singles > PATIENCE)
            if len(late):
                for w, a, b in zip(late, np.searchsorted(word, late), np.searchsorted(word, late, "right"), strict=True):
                    done_sym.append(self._one_by_one(sym[a:b]))
                    done_word.append(np.full(len(done_sym[-1]), w, word.dtype))
                rest = singles[word] <= PATIENCE
                sym, word, at = sym[rest], word[rest], at[rest]
                singles[late] = 0
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        at = np.argsort(word, kind="stable")
        return sym[at], word[at]

    def _one_by_one(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one word after all its merges, each the least by (rank, place)."""
        s, n, known, heap = sym.tolist(), len(sym), {}, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> None:
            if after[i] < n:
                pair = s[i], s[after[i]]
                if pair not in known:
                    at = int(self.pair(np.array(pair[:1]), np.array(pair[1:]))[0])
                    known[pair] = (int(self.ranks[at]), int(self.made[at])) if at >= 0 else None
                if known[pair]:
                    heapq.heappush(heap, (known[pair][0], i, *pair))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:         # one of them has been merged since
                continue
            s[i], s[j], after[i] = known[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in s if x >= 0], sym.dtype)

    # -- words ---------------------------------------------------------------

    def learn(self) -> None:
        """Encode the fresh words, each after its space mark, and remember their ids."""
        words, self.cache.fresh = self.cache.fresh, []
        if not words:
            return
        text = MARK + MARK.join(words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inv = np.unique(cp, return_inverse=True)
        ids = np.array([self.symbols.get(chr(c), self.other) for c in chars], np.int64)
        raw = ids[inv]
        odd = raw == self.other
        # a character outside the vocabulary keeps its code point beside the symbols
        sym = np.where(odd, self.width + cp.astype(np.int64), raw)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64) + 1)
        sym, word = self._merge_known(sym, word, len(words))
        ids, word = self._to_ids(sym, word)
        counts = np.bincount(word, minlength=len(words))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def _merge_known(self, sym, word, n):
        """``merge`` with symbols outside the table as one that never merges."""
        odd = sym >= self.width
        if not odd.any():
            return self.merge(sym, word, n)
        # pieces between such symbols can't meet: they are words of their own
        part = np.cumsum(odd | np.append(True, odd[:-1]) | np.append(True, word[1:] != word[:-1])) - 1
        known = ~odd
        s, p = self.merge(sym[known], part[known], int(part[-1]) + 1)
        of_part = np.zeros(int(part[-1]) + 1, np.int64)
        of_part[part] = word
        s, p = np.concatenate([s, sym[odd]]), np.concatenate([p, part[odd]])
        at = np.argsort(p, kind="stable")
        return s[at], of_part[p[at]]

    def _to_ids(self, sym, word):
        """Symbols outside the vocabulary as the byte pieces of their UTF-8 form."""
        odd = np.flatnonzero(sym >= self.n)
        if not len(odd):
            return sym, word
        char_of = {v: k for k, v in self.symbols.items() if v >= self.n}
        width = np.ones(len(sym), np.int64)
        enc = {}
        for s in np.unique(sym[odd]).tolist():
            c = char_of.get(s) or chr(s - self.width)
            enc[s] = self.byte_id[list(c.encode("utf-8", "replace"))]
        parts = [enc[s] for s in sym[odd].tolist()]
        width[odd] = [len(x) for x in parts]
        out = np.repeat(sym, width)
        first = np.cumsum(width) - width
        for k in range(4):
            some = [n for n, x in enumerate(parts) if len(x) > k]
            if some:
                out[first[odd[some]] + k] = [parts[n][k] for n in some]
        return out, np.repeat(word, width)

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the space mark that leads it."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in self.splitter.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and each text's number of ids."""
        if len(self.cache) > CACHE_WORDS:
            self.forget()
        docs = [self.words(t) for t in texts]
        code = self.cache.__getitem__
        places = [np.fromiter(map(code, d), np.int64, len(d)) for d in docs]
        self.learn()
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        counts = self.start[at + 1] - self.start[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(total)]
        upto = np.append(0, ends)[np.cumsum([0] + [len(d) for d in docs])]
        return ids, np.diff(upto)

    # -- decoding ------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of flat ids: pieces side by side, the dummy prefix taken off."""
        ids = np.asarray(ids, np.int64)
        n = self.raw_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.raw[np.repeat(self.raw_at[ids] - (ends - n), n) + np.arange(total)].tobytes()
        upto = np.append(0, ends)
        edge = np.cumsum(np.append(0, counts))
        texts = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            c = a
            while c < b and self.control[ids[c]]:
                c += 1
            part = out[upto[a]:upto[b]]
            if c < b and self.marked[ids[c]]:
                part = part[1:]
            texts.append(_utf8(part))
        return texts


def _utf8(b: bytes) -> str:
    """UTF-8 to text; a byte that starts no valid character becomes U+FFFD."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for n in (1, 2, 3, 4):
                try:
                    out.append(b[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@functools.lru_cache(maxsize=4)
def _shared(data: bytes) -> PieceModel:
    return PieceModel(data)


class _Handle:
    """The model's bytes, sent once per application; parsed once per worker."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.data = spark.sparkContext.broadcast(f.read())

    def model(self) -> PieceModel:
        return _shared(self.data.value)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus array column ``ids`` of the token ids of ``text``.

    ``model_path`` is a file on the driver (some 0.5 MB, broadcast).  No begin
    or end ids.  Null text has an empty array.  Other columns pass through; one
    that is already called ``ids`` is replaced.
    """
    need(df, text)
    handle = _Handle(df.sparkSession, model_path)
    at = df.columns.index(text)
    keep = [i for i, c in enumerate(df.columns) if c.lower() != ids.lower()]

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        model = handle.model()
        texts = columns[at].cast(pa.string())
        values, offsets, base = [np.zeros(0, np.int32)], [0], 0
        for lo, hi in pieces_of(texts, CHUNK_CHARS):
            got, counts = model.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
            values.append(got)
            offsets.extend((base + np.cumsum(counts)).tolist())
            base += len(got)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                         pa.array(np.concatenate(values), pa.int32()))
        return [columns[i] for i in keep] + [lists]

    return map_batches(df, one, [df.dtypes[i] for i in keep] + [(ids, "array<int>")],
                       done=lambda: handle.model().forget())


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the array column ``ids`` replaced by its decoded text.

    A null array decodes to the empty string.  A column that is already called
    ``text`` is replaced.
    """
    need(df, ids)
    handle = _Handle(df.sparkSession, model_path)
    at = df.columns.index(ids)
    keep = [i for i, c in enumerate(df.columns) if i != at and c.lower() != text.lower()]

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        model = handle.model()
        counts = pc.fill_null(pc.list_value_length(columns[at]), 0).to_numpy(zero_copy_only=False)
        flat = columns[at].flatten().to_numpy(zero_copy_only=False)
        edges = np.append(0, np.cumsum(counts))
        texts: list[str] = []
        for lo in range(0, len(counts), 256):
            hi = min(len(counts), lo + 256)
            texts += model.decode(flat[edges[lo]:edges[hi]], counts[lo:hi])
        return [columns[i] for i in keep] + [pa.array(texts, pa.string())]

    return map_batches(df, one, [df.dtypes[i] for i in keep] + [(text, "string")])


def digests(df: DataFrame, model_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of each row's text.

    Encodes, decodes and hashes in one pass, chunk by chunk, so that neither
    ids nor decoded texts leave the worker.  Columns are found by exact name.
    """
    rows = take(df, id=id, text=text)
    handle = _Handle(df.sparkSession, model_path)

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        model, texts, out = handle.model(), columns[1].cast(pa.string()), [[], [], []]
        for lo, hi in pieces_of(texts, CHUNK_CHARS):
            ids, counts = model.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
            edges = np.append(0, np.cumsum(counts)).tolist()
            shown = list(map(str, ids.tolist()))
            out[0] += counts.tolist()
            out[1] += [hashlib.sha256(",".join(shown[a:b]).encode()).hexdigest() for a, b in zip(edges, edges[1:])]
            out[2] += [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, counts)]
        return [columns[0], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]

    return map_batches(rows, one, [(id, rows.dtypes[0][1]), ("n_tokens", "bigint"), ("ids_sha256", "string"),
                                   ("decoded_sha256", "string")], done=lambda: handle.model().forget())
