"""Ranked lexical search by dual trees: every item's best documents, exactly.

Terms are runs of letters (A-Z lower-cased), digits and of everything beyond
ASCII.  With N documents that have a term, L terms in all, n in a document,
df documents with a term and tf occurrences of it in a document, a term weighs
``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and adds

    weight * (10^9 tf div (1000 tf + 12 m)),   m = 75 + (25 n N div L)

to the document's score for each of its occurrences in the item.

1. One pass over the texts keeps each document's length and its counts of the
   items' terms; N, L and df are sums over all documents.
2. Each task takes its documents in groups and builds a balanced tree over a
   group, by halves that have little in common.  A node holds the greatest value that any of its documents has in each
   coordinate (term).  Another tree stands over the items, likewise.
3. For an item node and a document node, the products of their maxima add up
   to a bound: no document of the one scores more for an item of the other.
   Where it is below the weakest kth score of the node's items so far, the
   pair is dropped with all that is under it; else its children are compared.
   At the leaves the documents are scored, best bounds first.
4. A task hands on its best ``k`` documents per item, and the best of all
   tasks are ranked.

Bounds are doubles, raised by more than their rounding error; scores are
whole numbers, in doubles only where all sums stay under 2^53.

Items come to the driver in parts of about ``ITEM_BYTES`` of text, as many
passes as there are parts; a task's memory is bounded by ``GROUP_ROWS`` and
``GROUP_ENTRIES`` and by the cells of a block of items (``CELLS``).

Defined cases: a null text has no term; an item without a term, or whose terms
no document holds, gets no row; rows that share an item's id are items of
their own, and likewise documents; equal scores go by ascending document id, a
null id last; an empty table on either side gives no row; columns are found by
exact name.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Scratch, bound_batches, map_batches, pieces_of, take
from .divergence import split_terms

K = 20
ITEM_BYTES = 32 << 20
BLOCK_ITEMS, BLOCK_TERMS = 256, 8192     # of items that are searched together
ITEM_LEAF, DOC_LEAF = 2, 32              # rows of a tree's leaf
ROUNDS = 4                               # of halving a node
GROUP_ROWS, GROUP_ENTRIES = 8192, 1 << 21
CELLS = 1 << 22
SLICE = 8 << 20                          # bytes of text counted at a time
SLACK = 1 + 1e-9                         # on bounds
#: Letters, lower-cased, and digits as they are, everything else of ASCII as a space.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32
              for c in range(256))


# -- sparse rows ----------------------------------------------------------

@dataclasses.dataclass
class Rows:
    """Sparse rows: row i has the values ``value[start[i]:start[i + 1]]`` at the coordinates ``at``."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def pick(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - ends + size, size)
        return Rows(np.concatenate([[0], ends]).astype(np.int64), self.at[where], self.value[where])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def within(self, local: np.ndarray) -> Rows:
        """Only the coordinates with ``local`` >= 0, which is their new number."""
        new = local[self.at]
        keep = new >= 0
        kept = np.concatenate([[0], np.cumsum(keep)])[self.start]
        return Rows(kept, new[keep], self.value[keep])

    def dense(self, width: int, kind: type) -> np.ndarray:
        out = np.zeros((len(self), width), kind)
        out[self.row_of(), self.at] = self.value
        return out


def order(rows: Rows, width: int, leaf: int) -> np.ndarray:
    """The rows in an order in which similar ones stand together: halved again and again.

    A part is halved at the median along the direction between a row and one
    that has least in common with it, and then ``ROUNDS`` times along that
    between the halves' means, so that what belongs together gathers on a side.
    """
    out, work = np.arange(len(rows)), [(0, len(rows))]
    while work:
        lo, hi = work.pop()
        if hi - lo <= leaf:
            continue
        part, middle = rows.pick(out[lo:hi]), (hi - lo) // 2
        row = part.row_of()
        side = np.zeros(hi - lo)
        for _ in range(2):                         # from the first row, then from the one furthest from it
            far = int(np.argmin(side))
            one = np.zeros(width)
            one[part.at[part.start[far]:part.start[far + 1]]] = part.value[part.start[far]:part.start[far + 1]]
            near = np.bincount(row, part.value * one[part.at], hi - lo) / max(math.sqrt(one @ one), 1e-300)
            side = near - side
        for _ in range(ROUNDS):
            sign = np.ones(hi - lo)
            sign[np.argpartition(side, middle)[:middle]] = -1
            between = np.bincount(part.at, part.value * sign[row], width)
            side = np.bincount(row, part.value * between[part.at], hi - lo)
        out[lo:hi] = out[lo:hi][np.argpartition(side, middle)]
        work += [(lo, lo + middle), (lo + middle, hi)]
    return out


class Tree:
    """A complete binary tree over rows in their order; ``peak[level]`` has each node's coordinate maxima."""

    def __init__(self, rows: Rows, width: int, leaf: int):
        depth = 0
        while len(rows) > leaf << depth and width << depth < CELLS:
            depth += 1
        self.depth, n = depth, len(rows)
        self.bounds = np.arange((1 << depth) + 1) * n >> depth              # of the leaves' rows
        node = np.searchsorted(self.bounds, np.arange(n), "right") - 1
        peak = np.zeros(width << depth)
        np.maximum.at(peak, node[rows.row_of()] * width + rows.at, rows.value.astype(float))
        self.peak = [peak.reshape(1 << depth, width)]
        while len(self.peak[0]) > 1:
            self.peak.insert(0, np.maximum(self.peak[0][::2], self.peak[0][1::2]))


# -- items ----------------------------------------------------------------

@dataclasses.dataclass
class Block:
    """Items that are searched together: their weights by local term, and their tree."""

    item: np.ndarray            # their numbers
    terms: np.ndarray           # the local terms' numbers, ascending
    weights: Rows
    tree: Tree
    exact: bool                 # whether all scores are exact in doubles


def counted(texts: pa.Array) -> list[Counter]:
    return [Counter(w for w in words if w) for words in split_terms(pc.fill_null(texts, ""), SIGNS).to_pylist()]


def make_blocks(items: list[Counter], number: dict[str, int], weight: np.ndarray) -> list[Block]:
    """Blocks of similar items, by the weights of the terms."""
    used = [i for i, c in enumerate(items) if c]
    start = np.cumsum([0, *(len(items[i]) for i in used)])
    at = np.array([number[w] for i in used for w in items[i]], np.int64)
    rows = Rows(start, at, weight[at] * np.array([n for i in used for n in items[i].values()], np.int64))
    blocks, picked, terms = [], [], set()

    def close() -> None:
        if picked:
            local = np.full(len(weight), -1, np.int64)
            names = np.array(sorted(terms), np.int64)
            local[names] = np.arange(len(names))
            own = rows.pick(np.array(picked)).within(local)
            most = max((int(sum(own.value[a:b].tolist())) for a, b in zip(own.start, own.start[1:])), default=0)
            blocks.append(Block(np.array(used)[picked], names, own, Tree(own, len(names), ITEM_LEAF),
                                most * 10**6 < 2**53))

    for i in order(rows, len(weight), ITEM_LEAF) if used else []:
        new = set(at[start[i]:start[i + 1]].tolist())
        if picked and (len(picked) >= BLOCK_ITEMS or len(terms | new) > BLOCK_TERMS):
            close()
            picked, terms = [], set()
        picked.append(i)
        terms |= new
    close()
    return blocks


# -- search ---------------------------------------------------------------

class Best:
    """The best documents found for each item, over the groups of a task."""

    def __init__(self, items: int, k: int):
        self.k, self.scores, self.bar = k, [np.zeros(0, np.int64)] * items, np.ones(items, np.int64)

    def add(self, item: int, scores: np.ndarray) -> None:
        top = np.concatenate([self.scores[item], scores])
        if len(top) > self.k:
            top = np.partition(top, len(top) - self.k)[-self.k:]
        self.scores[item] = top
        if len(top) == self.k:
            self.bar[item] = max(self.bar[item], int(top.min()))


def search_group(block: Block, docs: Rows, tree: Tree, best: Best, seen: list[int]) -> list[tuple]:
    """(item, rows, scores) of the documents that reach their item's bar; ``seen`` counts scored pairs.

    ``docs`` and ``tree`` are in the block's local terms.  The two trees are
    descended level by level together; the shallower one waits at its leaves.
    """
    found = []
    items, depth = block.tree, max(block.tree.depth, tree.depth)
    bar_rows = best.bar[block.item]
    alive = {0: np.array([0])}                         # by item node: document nodes
    for level in range(depth + 1):
        a, b = min(level, items.depth), min(level, tree.depth)
        low = np.minimum.reduceat(bar_rows, _spans(items, a)[:-1]) if len(bar_rows) else bar_rows
        after = {}
        for i, nodes in alive.items():
            mine = items.peak[a][i]
            support = np.flatnonzero(mine)
            bound = tree.peak[b][nodes][:, support] @ mine[support] * SLACK
            keep = bound >= low[i]
            nodes, bound = nodes[keep], bound[keep]
            if not len(nodes):
                continue
            if level == depth:
                after[i] = (nodes, bound)
                continue
            below = np.concatenate([2 * nodes, 2 * nodes + 1]) if b < tree.depth else nodes
            for child in ((2 * i, 2 * i + 1) if a < items.depth else (i,)):
                after[child] = below
        alive = after
    spans = _spans(items, items.depth)
    for i, (nodes, bound) in alive.items():
        rows = np.arange(spans[i], spans[i + 1])
        weights = block.weights.pick(rows)
        support = np.unique(weights.at)
        local = np.full(tree.peak[0].shape[1], -1, np.int64)
        local[support] = np.arange(len(support))
        kind = np.float64 if block.exact else np.int64
        w = weights.within(local).dense(len(support), kind).T
        falling = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[falling], bound[falling]
        step = max(1, min(8, CELLS // max(1, len(support) * (int(np.diff(tree.bounds).max()) or 1))))
        for lo in range(0, len(nodes), step):
            part = nodes[lo:lo + step][bound[lo:lo + step] >= best.bar[block.item[rows]].min()]
            if not len(part):
                break                                   # bounds only fall
            which = np.concatenate([np.arange(tree.bounds[n], tree.bounds[n + 1]) for n in part])
            scores = (docs.pick(which).within(local).dense(len(support), kind) @ w).astype(np.int64)
            seen[0] += scores.size
            for j, item in enumerate(block.item[rows].tolist()):
                good = np.flatnonzero(scores[:, j] >= best.bar[item])
                if len(good):
                    best.add(item, scores[good, j])
                    found.append((item, which[good], scores[good, j]))
    return found


def _spans(tree: Tree, level: int) -> np.ndarray:
    return tree.bounds[::1 << (tree.depth - level)]


def search_documents(blocks: list[Block], start: np.ndarray, at: np.ndarray, tf: np.ndarray, n: np.ndarray,
                     names: pa.Array, weight: np.ndarray, docs_n: int, terms_n: int, best: Best,
                     seen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, row, score) of a group's documents that are among the best for an item so far."""
    m = 75 + np.array([25 * x * docs_n // terms_n for x in n.tolist()], np.int64)
    tf = tf.astype(np.int64)
    rows = Rows(start, at.astype(np.int64), 10**9 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(start))))
    placed = order(Rows(rows.start, rows.at, rows.value * weight[rows.at] / 1e6), len(weight), DOC_LEAF)
    rows = rows.pick(placed)
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names, null_placement="at_end").to_numpy()] = np.arange(len(names))
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    for block in blocks:
        local = np.full(len(weight), -1, np.int64)
        local[block.terms] = np.arange(len(block.terms))
        own = rows.within(local)
        tree = Tree(own, len(block.terms), DOC_LEAF)
        by_item: dict[int, list] = {}
        for item, which, scores in search_group(block, own, tree, best, seen):
            by_item.setdefault(item, []).append((which, scores))
        for item, parts in by_item.items():
            which, scores = (np.concatenate(x) for x in zip(*parts))
            good = scores >= best.bar[item]
            which, scores = placed[which[good]], scores[good]
            top = np.lexsort([rank[which], -scores])[:best.k]
            for column, values in zip(out, (np.full(len(top), item), which[top], scores[top])):
                column.append(values)
    return tuple(np.concatenate(c) for c in out)


# -- Spark ----------------------------------------------------------------

def count_terms(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(id, n, at array<int>, tf array<int>): a document's number of terms, and its counts of the numbered ones."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        names, texts = columns
        return [pa.concat_arrays(c) for c in zip(*[
            (names[lo:hi], *count(texts[lo:hi])) for lo, hi in pieces_of(texts, SLICE)])]

    def count(texts: pa.Array) -> list[pa.Array]:
        lists = split_terms(pc.fill_null(texts, ""), SIGNS)
        words = lists.flatten().dictionary_encode()
        get = known.value.get
        code = np.array([-2 if not w else get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
        code = code[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        n = np.bincount(doc[code > -2], minlength=len(texts))
        key, tf = np.unique((doc * len(known.value) + code)[code >= 0], return_counts=True)
        doc, at = np.divmod(key, max(1, len(known.value)))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
        return [pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))]

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", "text"), run, [
        ("id", kind), ("n", "bigint"), ("at", "array<int>"), ("tf", "array<int>")])


def _part(docs: DataFrame, items: list, item_kind: pa.DataType, k: int, scratch: Scratch) -> DataFrame | None:
    """(row, item_id, doc_id, score): each task's best for a part of the items."""
    spark = docs.sparkSession
    counts = counted(pa.array([r["text"] for r in items], pa.string()))
    number = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    vectors = scratch.write(count_terms(docs, number))
    docs_n, terms_n = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not terms_n or not number:
        return None
    weight = np.full(len(number), int(math.floor(1000 * math.log(2 * docs_n + 2))), np.int64)
    for at, df in vectors.select(F.explode("at").alias("at")).groupBy("at").count().collect():   # a row per item term
        weight[at] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))
    told = spark.sparkContext.broadcast((make_blocks(counts, number, weight), weight, [r["id"] for r in items],
                                         [r["row"] for r in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weight, item_ids, item_rows = told.value
        best, seen, held = Best(len(item_ids), k), [0], []

        def group() -> pa.RecordBatch:
            names, n, at, tf = (pa.concat_arrays(c) for c in zip(*held))
            start = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())]).astype(np.int64)
            item, row, score = search_documents(
                blocks, start, at.flatten().to_numpy(), tf.flatten().to_numpy(), n.to_numpy(), names, weight,
                docs_n, terms_n, best, seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(item_rows, np.int64)[item]), pa.array(item_ids, item_kind).take(pa.array(item)),
                 names.take(pa.array(row)), pa.array(score)], names=["row", "item_id", "doc_id", "score"])

        rows = entries = 0
        for b in batches:
            sizes = np.cumsum(pc.list_value_length(b.columns[2]).to_numpy())
            lo = 0
            while lo < b.num_rows:
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + GROUP_ENTRIES - entries, "right")))
                hi = min(hi, b.num_rows, lo + GROUP_ROWS - rows)
                held.append([c[lo:hi] for c in b.columns])
                rows, entries, lo = rows + hi - lo, entries + int(sizes[hi - 1] - done), hi
                if rows >= GROUP_ROWS or entries >= GROUP_ENTRIES:
                    yield group()
                    held, rows, entries = [], 0, 0
        if held:
            yield group()

    kinds = vectors.schema["id"].dataType.simpleString()
    return vectors.where(F.size("at") > 0).mapInArrow(
        run, f"row bigint, item_id {_sql_kind(item_kind)}, doc_id {kinds}, score bigint")


def _sql_kind(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type
    return from_arrow_type(kind).simpleString()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    scratch = Scratch(spark)
    docs = take(docs, id=doc_id, text=text)
    items = scratch.write(take(items, id=item_id, text=item_text)
                          .withColumn("row", F.monotonically_increasing_id()))
    item_kind = to_arrow_type(items.schema["id"].dataType)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // ITEM_BYTES + 1
    found = None
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).orderBy("row").collect()
        one = _part(docs, mine, item_kind, k, scratch) if mine else None
        if one is not None:
            found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], f"row bigint, item_id {items.schema['id'].dataType.simpleString()}, "
                                          f"doc_id {docs.schema['id'].dataType.simpleString()}, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
