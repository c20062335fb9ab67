"""Decision trees (classification: gini / entropy; regression: squared error).

Level-wise exact builder over presorted features: each (feature, value) has a
code, its place among all distinct ones, found once (``coded``).  Per level,
for the rows still in splittable nodes:

1. aggregate by (node, feature, code) the class counts (or sum / sum of
   squares) -- partial aggregation before the shuffle;
2. running sums in the order of codes that restart with every (node, feature),
   with the next value (``_running``): codes are cut into runs, so that a
   window has a bounded number of rows, also in a root that holds all;
3. every gap between neighbouring values is a candidate threshold (midpoint);
   the best of a node is a ``min_by`` aggregate with explicit ties (largest
   gain, then smallest feature position, then smallest threshold);
4. rows move to their child by a join with the (checked-size) split table.

Thresholds are exact (every distinct value).  A null counts below every value
of its feature, in fitting and in predicting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import as_double, check_columns, check_numeric
from ..functions.rank import global_rank, maybe_broadcast
from ..session import cut_lineage

FAN = 12                     # bits of a code that one window orders
CRITERIA = ("gini", "entropy", "squared_error")


@dataclass
class TreeModel:
    features: list[str]
    criterion: str
    classes: list | None
    nodes: DataFrame            # node table (see _node_schema)
    leaves: DataFrame           # (id, node) for the training rows
    n_rows: int

    @property
    def is_classifier(self):
        return self.classes is not None

    def shape(self) -> DataFrame:
        """One row: depth, n_leaves, n_nodes."""
        return self.nodes.agg(F.max("depth").cast("int").alias("depth"),
                              F.count_if("is_leaf").cast("bigint").alias("n_leaves"),
                              F.count(F.lit(1)).cast("bigint").alias("n_nodes"))

    def importance(self) -> DataFrame:
        """(pos, feature, importance): impurity decrease per feature, normalised."""
        spark = self.nodes.sparkSession
        feats = spark.createDataFrame(list(enumerate(self.features)), "pos int, feature string")
        g = (self.nodes.where(~F.col("is_leaf")).groupBy("feature_pos")
             .agg(F.sum("gain").alias("g")))
        tot = g.agg(F.sum("g")).first()[0] or 0.0
        out = feats.join(g, feats.pos == g.feature_pos, "left")
        return out.select("pos", "feature",
                          (F.coalesce(F.col("g"), F.lit(0.0)) / F.lit(tot if tot > 0 else 1.0))
                          .alias("importance"))

    def _leaf_values(self) -> list:
        if self.is_classifier:
            tot = F.col("weight")
            return [(F.col("counts")[i] / tot).alias(f"p_{c}")
                    for i, c in enumerate(self.classes)]
        return [F.col("value").alias("prediction")]

    def predict(self, df: DataFrame, id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
        """Route rows level by level through the split table (joins, no collect)."""
        x = [as_double(c) for c in self.features]
        cur = df.select(F.col(id).alias("_id"), *[F.col(k) for k in keep],
                        F.array(*x).alias("_x"), F.lit(0).cast("bigint").alias("node"))
        splits = self.nodes.where(~F.col("is_leaf")).select(
            "node", "feature_pos", "threshold", "left", "right")
        splits = cut_lineage(splits)
        n_split = splits.count()
        depth = self.nodes.agg(F.max("depth")).first()[0] or 0
        sp = maybe_broadcast(splits, n_split)
        for _ in range(depth):
            j = cur.join(sp, "node", "left")
            go_left = F.coalesce(F.element_at("_x", F.col("feature_pos") + 1) <= F.col("threshold"), F.lit(True))
            nxt = (F.when(F.col("feature_pos").isNull(), F.col("node"))
                   .when(go_left, F.col("left")).otherwise(F.col("right")))
            cur = j.select("_id", *keep, "_x", nxt.alias("node"))
        leaves = self.nodes.where("is_leaf")
        n_leaf = leaves.count()
        out = cur.join(maybe_broadcast(leaves, n_leaf), "node")
        cols = [F.col("_id").alias(id), *[F.col(k) for k in keep]]
        if self.is_classifier:
            cls = F.array(*[F.lit(c) for c in self.classes])
            cols.append(cls[F.col("argmax")].alias("prediction"))
        return out.select(*cols, *self._leaf_values())

    def training_predictions(self, df: DataFrame, id: str = "id",
                             keep: Sequence[str] = ()) -> DataFrame:
        lv = self.nodes.where("is_leaf")
        j = df.select(F.col(id), *[F.col(k) for k in keep]).join(
            self.leaves.withColumnRenamed("_id", id), id).join(
            maybe_broadcast(lv, lv.count()), "node")
        cols = [F.col(id), *[F.col(k) for k in keep]]
        if self.is_classifier:
            cls = F.array(*[F.lit(c) for c in self.classes])
            cols.append(cls[F.col("argmax")].alias("prediction"))
        return j.select(*cols, *self._leaf_values())


def _impurity(criterion, counts, total, s=None, s2=None):
    """Column expression of total * impurity (weighted)."""
    if criterion == "squared_error":
        return s2 - s * s / total
    if criterion == "gini":
        sq = sum((c * c for c in counts), F.lit(0.0))
        return total - sq / total
    ent = F.lit(0.0)
    for c in counts:
        ent = ent - F.when(c > 0, c * F.log2(c / total)).otherwise(F.lit(0.0))
    return ent


def fit(df: DataFrame, features: Sequence[str], label: str, id: str = "id",
        criterion: str = "gini", max_depth: int | None = None,
        min_samples_split: int = 2, min_samples_leaf: int = 1,
        weight: str | None = None) -> TreeModel:
    """Grow a tree; ``max_depth`` None or 0 = unlimited."""
    criterion = criterion.strip().lower()
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    features = list(features)
    check_numeric(df, features)
    check_columns(df, [id, label])
    spark = df.sparkSession
    regression = criterion == "squared_error"
    max_depth = None if not max_depth else int(max_depth)
    p = len(features)
    y = as_double(label) if regression else F.col(label)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(id).alias("_id"), *[as_double(c).alias(f"_f{j}")
                                               for j, c in enumerate(features)],
                     y.alias("_y"), w.alias("_w")).where(F.col("_w") > 0)
    rows, codes = coded(rows, p)
    n_rows = rows.count()
    classes = None
    if not regression:
        classes = [r[0] for r in rows.select("_y").distinct().orderBy("_y").collect()]
    if regression:
        stat_aggs = [F.sum("_w").alias("W"), F.sum(F.col("_w") * F.col("_y")).alias("S"),
                     F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("S2")]
    else:
        stat_aggs = [F.sum("_w").alias("W")] + [
            F.sum(F.when(F.col("_y") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"c{i}")
            for i, c in enumerate(classes)]
    stat_cols = ["W", "S", "S2"] if regression else ["W"] + [f"c{i}" for i in range(len(classes))]

    active = rows.withColumn("node", F.lit(0).cast("bigint"))
    node_tables = []
    leaf_tables = []
    next_id = 1
    depth = 0
    while True:
        # node statistics for this level
        ns = active.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *stat_aggs)
        if regression:
            imp_tot = _impurity(criterion, None, F.col("W"), F.col("S"), F.col("S2"))
        else:
            imp_tot = _impurity(criterion, [F.col(f"c{i}") for i in range(len(classes))],
                                F.col("W"))
        ns = ns.withColumn("wimp", imp_tot)
        can_split = ((F.col("n") >= F.lit(max(min_samples_split, 2 * min_samples_leaf)))
                     & (F.col("wimp") > F.lit(1e-12) * F.col("W")))
        if max_depth is not None and depth >= max_depth:
            can_split = F.lit(False)
        ns = cut_lineage(ns.withColumn("can_split", can_split))
        n_nodes = ns.count()
        if n_nodes == 0:
            break
        best = _best_splits(active, ns.where("can_split"), p, regression, classes, criterion,
                            stat_cols, min_samples_leaf, codes)
        best = cut_lineage(best)
        n_best = best.count()
        # number the children: left = next_id + 2 r, right = left + 1
        if n_best:
            best = global_rank(best, [F.col("node")], "_r")
            best = best.select("*", (F.lit(next_id) + 2 * F.col("_r")).alias("left"),
                               (F.lit(next_id) + 2 * F.col("_r") + 1).alias("right")).drop("_r")
            best = cut_lineage(best)
        else:
            best = best.select("*", F.lit(None).cast("bigint").alias("left"),
                               F.lit(None).cast("bigint").alias("right"))
        nt = ns.join(maybe_broadcast(best, n_best), "node", "left").select(
            "node", F.lit(depth).alias("depth"), "n", *stat_cols, "wimp",
            F.col("feature_pos").isNull().alias("is_leaf"), "feature_pos", "threshold",
            "gain", "left", "right")
        nt = cut_lineage(nt)
        node_tables.append(nt)
        leaf_ids = nt.where("is_leaf").select("node")
        leaf_tables.append(cut_lineage(
            active.join(leaf_ids, "node", "left_semi").select("_id", "node")))
        if n_best == 0:
            break
        next_id += 2 * n_best
        sp = maybe_broadcast(best.select("node", "feature_pos", "threshold", "left", "right"),
                             n_best)
        xarr = F.array(*[F.col(f"_f{j}") for j in range(p)])
        moved = active.join(sp, "node").withColumn(
            "node", F.when(F.coalesce(F.element_at(xarr, F.col("feature_pos") + 1) <= F.col("threshold"), F.lit(True)),
                           F.col("left")).otherwise(F.col("right")))
        # one reliable checkpoint per level keeps the plan (and recovery) short
        active = cut_lineage(moved.select(rows.columns + ["node"]))
        depth += 1
    nodes = node_tables[0]
    for t in node_tables[1:]:
        nodes = nodes.unionByName(t)
    leaves = leaf_tables[0]
    for t in leaf_tables[1:]:
        leaves = leaves.unionByName(t)
    if regression:
        nodes = nodes.withColumn("value", F.col("S") / F.col("W"))
        nodes = nodes.withColumn("weight", F.col("W"))
    else:
        k = len(classes)
        counts = F.array(*[F.col(f"c{i}") for i in range(k)])
        nodes = nodes.withColumn("counts", counts).withColumn("weight", F.col("W"))
        nodes = nodes.withColumn(
            "argmax", (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))
    nodes = nodes.withColumn("impurity", F.col("wimp") / F.col("W"))
    return TreeModel(features, criterion, classes, cut_lineage(nodes), leaves, n_rows)


def coded(rows: DataFrame, p: int) -> tuple[DataFrame, int]:
    """``rows`` (features ``_f0``, ...) with ``_codes``, and how many codes there are.

    A code is the place of a (feature, value) among all distinct ones, so the
    order of every feature is found once and levels only carry it down.
    """
    base = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    long = base.select("_row", F.posexplode(F.array(*[F.col(f"_f{j}") for j in range(p)])).alias("pos", "value"))
    values = cut_lineage(global_rank(long.select("pos", "value").distinct(), [F.col("pos"), F.col("value")], "code"))
    same = (long["pos"] == values["pos"]) & long["value"].eqNullSafe(values["value"])
    codes = (long.join(values, same).groupBy("_row")
             .agg(F.array_sort(F.collect_list(F.struct(long["pos"], "code"))).alias("_c"))
             .select("_row", F.transform("_c", lambda c: c["code"]).alias("_codes")))
    return cut_lineage(base.join(codes, "_row").drop("_row")), values.count()


def _running(h: DataFrame, keys: list[str], names: list[str], codes: int) -> DataFrame:
    """``B_<name>``, the sum of the rows before in the order of ``code``, and ``next``, the following ``first``.

    Sums restart with the keys.  A window has ``1 << FAN`` rows at most: codes
    are cut into runs, and the runs' totals summed in the same way.
    """
    top = codes <= 1 << FAN
    h = h.withColumn("_up", F.lit(0).cast("bigint") if top else F.shiftright("code", FAN))
    order = Window.partitionBy(*keys, "_up").orderBy("code")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = h.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"B_{c}") for c in names],
                   F.lead("first").over(order).alias("next"))
    if top:
        return out.drop("_up")
    runs = h.groupBy(*keys, F.col("_up").alias("code")).agg(
        *[F.sum(c).alias(c) for c in names], F.min("first").alias("first"))
    above = _running(runs, keys, names, (codes >> FAN) + 1).select(
        *keys, F.col("code").alias("_up"), *[F.col(f"B_{c}").alias(f"U_{c}") for c in names],
        F.col("next").alias("_after"))
    return out.join(above, [*keys, "_up"]).select(
        *h.drop("_up").columns, *[(F.col(f"B_{c}") + F.col(f"U_{c}")).alias(f"B_{c}") for c in names],
        F.coalesce("next", "_after").alias("next"))


def _best_splits(active, splittable, p, regression, classes, criterion, stat_cols, min_leaf, codes,
                 first_valid=False):
    """(node, feature_pos, threshold, gain) for every node with a valid split.

    ``active`` has the ``_codes`` of ``coded``.  A column ``chosen`` of
    ``splittable`` names the features to look at; ``first_valid`` takes the
    first of them that splits at all, not the best.
    """
    some = "chosen" in splittable.columns
    value = F.array(*[F.col(f"_f{j}") for j in range(p)])
    if some:
        a = active.join(splittable.select("node", "chosen"), "node")
        every = F.col("chosen")
    else:
        a = active.join(splittable.select("node"), "node", "left_semi")
        every = F.array(*[F.lit(j) for j in range(p)])
    long = (a.select("*", F.explode(every).alias("pos"))
            .select("node", "pos", F.get("_codes", "pos").alias("code"), F.get(value, "pos").alias("value"), "_y", "_w"))
    if regression:
        aggs = [F.sum("_w").alias("W"), F.sum(F.col("_w") * F.col("_y")).alias("S"),
                F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("S2")]
    else:
        aggs = [F.sum("_w").alias("W")] + [
            F.sum(F.when(F.col("_y") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"c{i}")
            for i, c in enumerate(classes)]
    names = ["n"] + stat_cols
    # a code has one feature and value
    h = cut_lineage(long.groupBy("node", "code").agg(F.first("pos").alias("pos"), F.first("value").alias("value"),
                                                     F.count(F.lit(1)).alias("n"), *aggs)
                    .withColumn("first", F.struct("code", "value")).drop("value"))
    total = h.groupBy("node", "pos").agg(*[F.sum(c).alias(f"T_{c}") for c in names])
    c = _running(h, ["node", "pos"], names, codes).where("next is not null").join(total, ["node", "pos"])
    left = {k: F.col(f"B_{k}") + F.col(k) for k in names}
    tot = {k: F.col(f"T_{k}") for k in names}
    right = {k: tot[k] - left[k] for k in names}
    if regression:
        imp = lambda d: _impurity(criterion, None, d["W"], d["S"], d["S2"])
    else:
        imp = lambda d: _impurity(
            criterion, [d[f"c{i}"] for i in range(len(classes))], d["W"])
    gain = imp(tot) - imp(left) - imp(right)
    low, high = F.col("first.value"), F.col("next.value")
    thr = (low + high) / 2.0
    thr = F.when(thr >= high, low).otherwise(thr)
    cand = c.where((left["n"] >= min_leaf) & (right["n"] >= min_leaf)).select(
        "node", F.col("pos").alias("feature_pos"), thr.alias("threshold"), gain.alias("gain")
    ).where("threshold is not null")
    rank = [-F.col("gain"), F.col("feature_pos"), F.col("threshold")]
    if first_valid:
        cand = cand.join(splittable.select("node", "chosen"), "node")
        rank.insert(0, F.array_position("chosen", F.col("feature_pos")))
    return cand.groupBy("node").agg(
        F.min_by(F.struct("feature_pos", "threshold", "gain"), F.struct(*rank)).alias("b")
    ).select("node", "b.*")
