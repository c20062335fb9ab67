"""Random forests (classification: gini; regression: squared error), exact and without depth limit.

A node is named by its tree and the turns from its root (``3``, ``3L``,
``3LR``), and all randomness is a hash of such names:

* tree t holds a row with weight Poisson(1), by ``md5(seed:t:id)``;
* a node looks at the first ``max_features`` features in the order of
  ``md5(seed:node:position)``; if none of them splits it, at the others one
  by one in that order.

All trees grow at once, on one frontier of (row, node).  While a node has more
than ``LOCAL_ROWS`` rows, its level is a set of Spark aggregates over sorted
distinct values (``tree._best_splits``).  A node of at most ``LOCAL_ROWS``
rows is finished with all its descendants in one task, by the same rule in
numpy; so a task's memory is bounded, a deep tree doesn't cost a round of jobs
a level, and the place of the change doesn't show in the result (but for the
rounding of sums in regression).  Without a depth limit a level is a round over
all rows for each turn of the deepest large node, so tasks take nodes of up to
``LOCAL_VALUES`` numbers.  A task goes through its nodes by their size, nodes of
the same few rows together.  Nodes that levels reach at ``max_depth`` are
leaves made of the level's sums.

Rows find their leaves the same way: by joins through the nodes that levels
split, then, ``LOCAL_ROWS`` at a time, with the whole subtree below in one task.

Thresholds are midpoints between neighbouring distinct values.  Ties go to the
smaller feature position, then the smaller threshold.  ``min_samples_*`` count
rows of the bag, not weights.  Probabilities and predictions are means over
the trees; ties between classes go to the first.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.rank import maybe_broadcast
from ..session import cut_lineage, ship_package
from .tree import _best_splits, _impurity, coded

LOCAL_ROWS = 50_000
LOCAL_VALUES = 2_000_000   # rows times columns that a task takes in a forest without depth limit
BAG_SHARE = 0.64           # of the rows that a bag holds at least once, and a little more
DEALT_ROWS = 4_000_000     # rows of all trees that a task makes, about
TOGETHER = 128             # rows of a node up to which nodes of equal size are split together
PURE = 1e-12               # share of the weight below which a node's impurity counts as none
# a bag's weight is the number of these that the first 32 bits of the row's hash reach
POISSON = [math.ceil(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
NODE_SCHEMA = ("node string, tree int, depth int, n bigint, weight double, stats array<double>, "
               "feature_pos int, threshold double, gain double")
# the subtree that a task finished, a node's place in it and those of its children (-1: a leaf); null for a node of the levels
ROOTED_SCHEMA = NODE_SCHEMA + ", root string, place int, low int, high int"


def subset_size(max_features, p: int) -> int:
    """Features that a node looks at first."""
    name = str(max_features).strip().lower()
    if name in ("sqrt", "auto"):
        return max(1, int(math.sqrt(p)))
    if name == "log2":
        return max(1, int(math.log2(p)))
    if name in ("all", "none"):
        return p
    size = float(name)
    size = int(size * p) if "." in name and size <= 1 else int(size)
    if not 0 < max(size, 1) <= p:
        raise ValueError(f"max_features={max_features!r} needs 1 to {p} features")
    return max(1, size)


def feature_order(seed: int, node: str, p: int) -> list[int]:
    return sorted(range(p), key=lambda j: (hashlib.md5(f"{seed}:{node}:{j}".encode()).hexdigest(), j))


def _order_column(seed: int, p: int) -> Column:
    """``feature_order`` of the column ``node``."""
    named = F.array(*[F.struct(F.md5(F.concat(F.lit(f"{seed}:"), "node", F.lit(f":{j}"))).alias("h"),
                               F.lit(j).alias("j")) for j in range(p)])
    return F.transform(F.array_sort(named), lambda s: s["j"])


def bag_weight(seed: int, tree: Column, id: Column) -> Column:
    """How often a tree's bag holds a row."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), id.cast("string"))), 1, 8),
               16, 10).cast("bigint")
    weight = lambda v: sum((F.when(v >= t, 1.0).otherwise(0.0) for t in POISSON), F.lit(0.0))
    return F.get(F.transform(F.array(u), weight), F.lit(0))        # hashes once, not for each comparison


@dataclass(frozen=True)
class _Rule:
    """What decides a split; goes to the tasks."""
    p: int
    n_classes: int             # 0 for regression
    first: int                 # features to look at before the others
    max_depth: int | None
    min_split: int
    min_leaf: int
    seed: int

    def stats(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.n_classes:
            return np.bincount(y.astype(np.int64), w, self.n_classes)
        return np.array([(w * y).sum()])

    def split(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, node: str, depth: int):
        """(position, threshold, gain) of a node's best split, None for a leaf."""
        n, total = len(y), w.sum()
        if n < max(self.min_split, 2 * self.min_leaf) or self.max_depth is not None and depth >= self.max_depth:
            return None
        if self.n_classes:
            sums = np.zeros((n, self.n_classes))
            sums[np.arange(n), y.astype(np.int64)] = w
            impurity = lambda s, t: t - (s * s).sum(-1) / t
            whole = impurity(sums.sum(0), total)
        else:
            off = y - (w * y).sum() / total            # from the node's mean: sums stay small
            sums = (w * off)[:, None]
            impurity = lambda s, t: -(s * s).sum(-1) / t
            whole = impurity(sums.sum(0), total)
            if (w * off * off).sum() <= PURE * total:
                return None
        if self.n_classes and whole <= PURE * total:
            return None

        def best_of(j: int):
            at = np.argsort(x[:, j], kind="stable")
            v = x[at, j]
            gap = np.flatnonzero(v[:-1] < v[1:])
            gap = gap[(gap + 1 >= self.min_leaf) & (n - gap - 1 >= self.min_leaf)]
            if not len(gap):
                return None
            left, lw = np.cumsum(sums[at], 0)[gap], np.cumsum(w[at])[gap]
            gain = whole - impurity(left, lw) - impurity(sums.sum(0) - left, total - lw)
            k = int(np.argmax(gain))
            low, high = v[gap[k]], v[gap[k] + 1]
            mid = (low + high) / 2.0
            return j, float(low if mid >= high else mid), float(gain[k])

        order = feature_order(self.seed, node, self.p)
        found = [b for b in map(best_of, sorted(order[:self.first])) if b]
        if found:
            return max(found, key=lambda b: b[2])       # the first of equals has the smallest position
        return next(filter(None, map(best_of, order[self.first:])), None)

    def split_all(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, names: list[str], depth: np.ndarray):
        """``split`` of nodes (x: nodes x rows x p) of equal size: positions (-1 for a leaf), thresholds, gains."""
        k, n = y.shape
        pos, cut, won = np.full(k, -1), np.full(k, np.nan), np.full(k, np.nan)
        if n < max(self.min_split, 2 * self.min_leaf, 2):
            return pos, cut, won
        total = w.sum(axis=1)
        if self.n_classes:
            sums = np.zeros((k, n, self.n_classes))
            np.put_along_axis(sums, y.astype(np.int64)[:, :, None], w[:, :, None], axis=2)
            impurity = lambda s, t: t - (s * s).sum(-1) / t
        else:
            off = y - ((w * y).sum(axis=1) / total)[:, None]
            sums = (w * off)[:, :, None]
            impurity = lambda s, t: -(s * s).sum(-1) / t
        every = sums.sum(axis=1)
        whole = impurity(every, total)
        able = ~((whole if self.n_classes else (w * off * off).sum(axis=1)) <= PURE * total)
        if self.max_depth is not None:
            able &= depth < self.max_depth

        def offer(at, j, beats):
            """Feature j at nodes ``at``: taken where it splits and ``beats`` what there is."""
            v = x[at, :, j]
            by = np.argsort(v, axis=1, kind="stable")
            v = np.take_along_axis(v, by, axis=1)
            ends = np.arange(1, n)
            gap = (v[:, :-1] < v[:, 1:]) & (ends >= self.min_leaf) & (n - ends >= self.min_leaf)
            left = np.cumsum(np.take_along_axis(sums[at], by[:, :, None], axis=1), axis=1)[:, :-1]
            lw = np.cumsum(np.take_along_axis(w[at], by, axis=1), axis=1)[:, :-1]
            gain = (whole[at, None] - impurity(left, lw)
                    - impurity(every[at, None] - left, total[at, None] - lw))
            gain = np.where(gap, gain, -np.inf)
            best = np.argmax(gain, axis=1)
            i = np.arange(len(at))
            ok = gap.any(axis=1) & beats(at, gain[i, best])
            low, high = v[i, best], v[i, np.minimum(best + 1, n - 1)]
            mid = (low + high) / 2.0
            at, i = at[ok], i[ok]
            pos[at], won[at], cut[at] = j, gain[i, best[i]], np.where(mid >= high, low, mid)[i]

        ranks = np.zeros((k, self.p), np.int64)           # of a feature in the node's order
        if self.p > 1:
            for i in np.flatnonzero(able):
                ranks[i, feature_order(self.seed, names[i], self.p)] = np.arange(self.p)
        for j in range(self.p):               # the first of equals has the smallest position
            at = np.flatnonzero(able & (ranks[:, j] < self.first))
            if len(at):
                offer(at, j, lambda at, gain: (pos[at] < 0) | (gain > won[at]))
        for r in range(self.first, self.p):
            for j in range(self.p):
                at = np.flatnonzero(able & (pos < 0) & (ranks[:, j] == r))
                if len(at):
                    offer(at, j, lambda at, gain: pos[at] < 0)
        return pos, cut, won

    def finish(self, rows: pa.Table) -> pa.Table:
        """A node's rows to the table of the node and all its descendants."""
        x = np.stack([rows[f"_f{j}"].to_numpy() for j in range(self.p)], axis=1).astype(np.float64)
        y, w = (rows[c].to_numpy().astype(np.float64) for c in ("_y", "_w"))
        root, tree = rows["node"][0].as_py(), rows["tree"][0].as_py()
        most, width = 2 * len(y), self.n_classes or 1             # each leaf has a row
        names, of, made = [root], {0: np.arange(len(y))}, 1
        size, depth, pos, low, high = (np.full(most, -1, np.int32) for _ in range(5))
        weight, cut, gain = (np.full(most, np.nan) for _ in range(3))
        stats = np.zeros((most, width))
        depth[0] = len(root.lstrip("0123456789"))
        sizes, todo = {len(y): [0]}, [-len(y)]
        # children are smaller than their parent: all nodes of a size are there when it comes
        while todo:
            n = -heapq.heappop(todo)
            nodes = sizes.pop(n)
            step = max(1, 100_000 // n)
            for lo in range(0, len(nodes), step):
                some = nodes[lo:lo + step]
                k = len(some)
                at = np.concatenate([of.pop(i) for i in some]).reshape(k, n)
                xs, ys, ws = x[at], y[at], w[at]
                size[some], weight[some] = n, ws.sum(axis=1)
                if self.n_classes:
                    group = np.arange(k)[:, None] * width + ys.astype(np.int64)
                    stats[some] = np.bincount(group.ravel(), ws.ravel(), k * width).reshape(k, width)
                else:
                    stats[some, 0] = (ws * ys).sum(axis=1)
                called = [names[i] for i in some]
                if n <= TOGETHER:
                    j, c, g = self.split_all(xs, ys, ws, called, depth[some])
                else:
                    got = [self.split(*rows, depth[i]) or (-1, np.nan, np.nan)
                           for i, *rows in zip(some, xs, ys, ws, called)]
                    j, c, g = (np.array(v) for v in zip(*got))
                pos[some], cut[some], gain[some] = j, c, g
                split = np.flatnonzero(j >= 0)
                left = xs[split, :, j[split]] <= c[split, None]
                for i, here, turn in zip(split.tolist(), at[split], left):
                    node = some[i]
                    low[node], high[node], depth[made:made + 2] = made, made + 1, depth[node] + 1
                    names += [called[i] + "L", called[i] + "R"]
                    for child in (here[turn], here[~turn]):
                        of[made] = child
                        if len(child) not in sizes:
                            sizes[len(child)] = []
                            heapq.heappush(todo, -len(child))
                        sizes[len(child)].append(made)
                        made += 1
        leaf = pos[:made] < 0
        # a missing label makes nulls, which means and sums leave out
        column = lambda v, mask=None: pa.array(v[:made], mask=mask, from_pandas=True)
        ends = pa.array(np.arange(made + 1, dtype=np.int32) * width)
        return pa.table({
            "node": pa.array(names, pa.string()), "tree": column(np.full(most, tree, np.int32)), "depth": column(depth),
            "n": column(size.astype(np.int64)), "weight": column(weight),
            "stats": pa.ListArray.from_arrays(ends, pa.array(stats[:made].ravel(), from_pandas=True)),
            "feature_pos": column(pos, leaf), "threshold": column(cut), "gain": column(gain),
            "root": pa.array([root] * made, pa.string()), "place": column(np.arange(most, dtype=np.int32)),
            "low": column(low), "high": column(high)})


@dataclass
class ForestModel:
    features: list[str]
    classes: list | None
    n_trees: int
    rooted: DataFrame          # ROOTED_SCHEMA; stats are class weights, or the weighted sum of the label
    part_rows: int = LOCAL_ROWS      # that look for their leaves in one task

    @property
    def nodes(self) -> DataFrame:
        """NODE_SCHEMA"""
        return self.rooted.drop("root", "place", "low", "high")

    def shape(self) -> DataFrame:
        """(tree, depth, n_leaves, n_nodes), one row per tree."""
        return self.nodes.groupBy("tree").agg(
            F.max("depth").alias("depth"), F.count_if(F.col("feature_pos").isNull()).alias("n_leaves"),
            F.count(F.lit(1)).alias("n_nodes"))

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
        """``id``, ``keep``, ``prediction`` and, of a classifier, ``p_<class>``: means over the trees."""
        tasks = int(df.count() * self.n_trees // DEALT_ROWS) + 1
        df = df.repartition(tasks) if tasks > 1 else df
        base = cut_lineage(df.select(F.col(id), *[F.col(k) for k in keep],
                                     F.array(*[as_double(c) for c in self.features]).alias("_x"),
                                     F.monotonically_increasing_id().alias("_row")))
        cur = base.select("_row", "_x", F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))
                                                  .cast("array<string>")).alias("node"))
        top = self.rooted.where("root is null and feature_pos is not null")
        n, depth = top.agg(F.count(F.lit(1)), F.max("depth")).first()
        splits = maybe_broadcast(top.select("node", "feature_pos", "threshold"), n)
        for level in range(depth + 1 if n else 0):
            turn = F.when(F.element_at("_x", F.col("feature_pos") + 1) <= F.col("threshold"), "L").otherwise("R")
            cur = cur.join(splits, "node", "left").select(
                "_row", "_x", F.when(F.col("feature_pos").isNull(), F.col("node"))
                .otherwise(F.concat("node", turn)).alias("node"))
            if level % 10 == 9:                         # a plan of bounded length
                cur = cut_lineage(cur)
        p, width = len(self.features), len(self.classes) if self.classes is not None else 1
        cur = cut_lineage(cur.select("_row", F.col("node").alias("root"),
                                     *[F.get("_x", F.lit(j)).alias(f"_x{j}") for j in range(p)]))
        parts = cut_lineage(cur.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / self.part_rows).cast("int").alias("parts")))
        parts = maybe_broadcast(parts, parts.count())
        asking = cur.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("_row"), "parts").cast("int"))
        subtrees = (self.rooted.where("root is not null or feature_pos is null")
                    .select(F.coalesce("root", "node").alias("root"), F.coalesce("place", F.lit(0)).alias("place"), "low",
                            "high", "feature_pos", "threshold",
                            *[(F.get("stats", F.lit(i)) / F.col("weight")).alias(f"_p{i}") for i in range(width)])
                    .join(parts, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        ship_package(df.sparkSession)
        means = [f"_p{i}" for i in range(width)]
        mean = (subtrees.drop("parts").groupBy("root", "part").cogroup(asking.drop("parts").groupBy("root", "part"))
                .applyInArrow(lambda nodes, rows: _leaf_means(nodes, rows, p, width),
                               ", ".join(["_row bigint", *[f"{m} double" for m in means]]))
                .groupBy("_row").agg(*[F.avg(m).alias(m) for m in means]))
        out = base.join(mean, "_row")
        cols = [F.col(id), *[F.col(k) for k in keep]]
        if self.classes is None:
            return out.select(*cols, F.col("_p0").alias("prediction"))
        p = F.array(*[F.col(f"_p{i}") for i in range(width)])
        cls = F.array(*[F.lit(c) for c in self.classes])
        return out.select(*cols, F.element_at(cls, F.array_position(p, F.array_max(p)).cast("int")).alias("prediction"),
                          *[F.col(f"_p{i}").alias(f"p_{c}") for i, c in enumerate(self.classes)])

    def importance(self, spark: SparkSession) -> DataFrame:
        """(pos, feature, importance): a tree's shares of the gain, their mean over trees that split."""
        feats = spark.createDataFrame(list(enumerate(self.features)), "pos int, feature string")
        gain = self.nodes.where("feature_pos is not null").groupBy("tree", "feature_pos").agg(F.sum("gain").alias("g"))
        whole = gain.groupBy("tree").agg(F.sum("g").alias("t")).where("t > 0")
        share = (gain.join(whole, "tree").groupBy("feature_pos").agg(F.sum(F.col("g") / F.col("t")).alias("s")))
        n = F.greatest(F.sum("s").over(_all()), F.lit(0.0))
        return (feats.join(share, feats.pos == share.feature_pos, "left").na.fill({"s": 0.0})
                .select("pos", "feature", F.when(n > 0, F.col("s") / n).otherwise(0.0).alias("importance")))


def _leaf_means(nodes: pa.Table, rows: pa.Table, p: int, width: int) -> pa.Table:
    """Each row's leaf of a subtree, as what the leaf predicts."""
    means = [f"_p{i}" for i in range(width)]
    if not nodes.num_rows or not rows.num_rows:
        return pa.table({"_row": pa.array([], pa.int64()), **{m: pa.array([], pa.float64()) for m in means}})
    by = np.argsort(nodes["place"].to_numpy())
    pos = nodes["feature_pos"].combine_chunks().fill_null(-1).to_numpy()[by]
    cut = nodes["threshold"].to_numpy()[by]
    low, high = (nodes[c].combine_chunks().fill_null(-1).to_numpy()[by] for c in ("low", "high"))
    x = np.stack([rows[f"_x{j}"].to_numpy() for j in range(p)], axis=1).astype(np.float64)
    at = np.zeros(rows.num_rows, np.int64)
    todo = np.flatnonzero(pos[at] >= 0)
    while len(todo):
        node = at[todo]
        at[todo] = np.where(x[todo, pos[node]] <= cut[node], low[node], high[node])        # a null goes right
        todo = todo[pos[at[todo]] >= 0]
    return pa.table({"_row": rows["_row"], **{m: pa.array(nodes[m].to_numpy()[by][at], from_pandas=True) for m in means}})


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()        # over one row per feature


def fit(df: DataFrame, features: Sequence[str], label: str, task: str = "classification",
        n_estimators: int = 100, max_depth: int | None = None, min_samples_split: int = 2,
        min_samples_leaf: int = 1, max_features: str = "sqrt", seed: int = 42, id: str = "id",
        local_rows: int | None = None) -> ForestModel:
    """Grow a forest; ``max_depth`` None or 0 = unlimited.  ``id`` must be unique: it deals the bags."""
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [label, id])
    if n_estimators < 1:
        raise ValueError("n_estimators must be at least 1")
    classes = None
    if task == "classification":
        classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
        # the codes 0, 1, ... of the classes in order, as a null-safe lookup
        y = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(float(i))) for i, c in enumerate(classes)],
                       F.lit(None)) if classes else F.lit(0.0)
    elif task == "regression":
        y = as_double(label)
    else:
        raise ValueError("task must be 'classification' or 'regression'")
    p = len(features)
    rule = _Rule(p, len(classes or ()), subset_size(max_features, p), int(max_depth) if max_depth else None,
                 max(2, int(min_samples_split)), max(1, int(min_samples_leaf)), int(seed))
    part_rows = LOCAL_ROWS if max_depth else max(LOCAL_ROWS, LOCAL_VALUES // (p + 2))
    local_rows = part_rows if local_rows is None else local_rows
    ship_package(df.sparkSession)
    trees = F.explode(F.sequence(F.lit(0), F.lit(int(n_estimators) - 1))).alias("tree")
    rows = df.select(F.col(id).alias("_id"), *[as_double(c).alias(f"_f{j}") for j, c in enumerate(features)],
                     y.alias("_y"))
    bagged = lambda t: (
        t.select("*", trees).withColumn("_w", bag_weight(seed, F.col("tree"), F.col("_id"))).drop("_id").where("_w > 0")
        .withColumn("node", F.col("tree").cast("string")))
    count = df.count()
    if count <= local_rows or BAG_SHARE * count + 1000 <= local_rows:
        dealt = rows.repartition(int(count * n_estimators // DEALT_ROWS) + 1) if count * n_estimators > DEALT_ROWS else rows
        return ForestModel(features, classes, int(n_estimators), cut_lineage(_finish(bagged(dealt), rule)), part_rows)
    rows, codes = coded(rows, p)
    active, tables, depth = cut_lineage(bagged(rows)), [], 0
    leaf = [F.lit(None).cast(kind).alias(c) for c, kind in (
        ("feature_pos", "int"), ("threshold", "double"), ("gain", "double"), ("root", "string"), ("place", "int"),
        ("low", "int"), ("high", "int"))]
    while True:
        nodes = cut_lineage(_node_stats(active, rule))
        if depth == rule.max_depth:                     # leaves, which need no more than their sums
            tables.append(nodes.select(*_node_columns(rule, depth), *leaf))
            break
        small = nodes.where(F.col("n") <= local_rows).select("node")
        n_small = small.count()
        if n_small:
            tables.append(cut_lineage(_finish(active.join(maybe_broadcast(small, n_small), "node", "left_semi"), rule)))
        big = nodes.where(F.col("n") > local_rows)
        n_big = big.count()
        if not n_big:
            break
        best = cut_lineage(_splits(active, big, rule, codes))
        n_best = best.count()
        tables.append(cut_lineage(big.join(maybe_broadcast(best, n_best), "node", "left").select(
            *_node_columns(rule, depth), "feature_pos", "threshold", "gain", *leaf[3:])))
        x = F.array(*[F.col(f"_f{j}") for j in range(p)])
        turn = F.when(F.element_at(x, F.col("feature_pos") + 1) <= F.col("threshold"), "L").otherwise("R")
        moved = (active.join(maybe_broadcast(best, n_best), "node")
                 .withColumn("node", F.concat("node", turn)).select(*active.columns))
        depth += 1
        active = moved if depth == rule.max_depth else cut_lineage(moved)      # leaves are read once only
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return ForestModel(features, classes, int(n_estimators), whole, part_rows)


def _finish(active: DataFrame, rule: _Rule) -> DataFrame:
    """The subtrees of nodes that fit into a task; each group has ``LOCAL_ROWS`` rows at most."""
    return active.drop("_codes").groupBy("node").applyInArrow(lambda rows: rule.finish(rows), ROOTED_SCHEMA)


def _stat_names(rule: _Rule) -> list[str]:
    return ["W", *([f"c{i}" for i in range(rule.n_classes)] or ["S", "S2"])]


def _node_columns(rule: _Rule, depth: int) -> list:
    """The first columns of NODE_SCHEMA, from those of ``_node_stats``."""
    return ["node", "tree", F.lit(depth).alias("depth"), "n", F.col("W").alias("weight"),
            F.array(*[F.col(c) for c in _stat_names(rule)[1:]][:rule.n_classes or 1]).alias("stats")]


def _node_stats(active: DataFrame, rule: _Rule) -> DataFrame:
    w, y = F.col("_w"), F.col("_y")
    sums = ([F.sum(F.when(y == float(i), w).otherwise(0.0)).alias(f"c{i}") for i in range(rule.n_classes)]
            or [F.sum(w * y).alias("S"), F.sum(w * y * y).alias("S2")])
    return active.groupBy("node", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("W"), *sums)


def _splits(active: DataFrame, big: DataFrame, rule: _Rule, codes: int) -> DataFrame:
    """(node, feature_pos, threshold, gain) of the large nodes that split."""
    regression = not rule.n_classes
    names = _stat_names(rule)
    impurity = _impurity("squared_error" if regression else "gini", [F.col(c) for c in names[1:]], F.col("W"),
                         F.col("S") if regression else None, F.col("S2") if regression else None)
    able = big.where((F.col("n") >= max(rule.min_split, 2 * rule.min_leaf)) & (impurity > PURE * F.col("W")))
    able = able.select("node", _order_column(rule.seed, rule.p).alias("order"))
    classes = None if regression else [float(i) for i in range(rule.n_classes)]
    find = lambda nodes, first_valid: _best_splits(
        active, nodes, rule.p, regression, classes, "squared_error" if regression else "gini", names,
        rule.min_leaf, codes, first_valid)
    best = cut_lineage(find(able.select("node", F.slice("order", 1, rule.first).alias("chosen")), False))
    if rule.first == rule.p:
        return best
    rest = able.join(best.select("node"), "node", "left_anti")
    if rest.isEmpty():
        return best
    others = rest.select("node", F.slice("order", rule.first + 1, rule.p).alias("chosen"))
    return best.unionByName(find(others, True))
