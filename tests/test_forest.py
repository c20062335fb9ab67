"""Forests against plain recursion over the same bags and feature orders."""

import hashlib
import random

import pytest

from tablelearn.operators import forest, search


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plain_forest(rows, p, trees, first, classes, seed, max_depth=None, min_split=2, min_leaf=1):
    """{node: (rows, weight, position, threshold)} by plain recursion; rows are (id, features, label)."""
    out = {}

    def impurity(part):
        w = sum(r[3] for r in part)
        if classes is None:
            mean = sum(r[3] * r[2] for r in part) / w
            return sum(r[3] * (r[2] - mean) ** 2 for r in part)
        return w - sum(sum(r[3] for r in part if r[2] == c) ** 2 for c in classes) / w

    def best_of(part, j):
        values = sorted({r[1][j] for r in part})
        got = []
        for low, high in zip(values, values[1:]):
            t = (low + high) / 2
            left, right = [r for r in part if r[1][j] <= t], [r for r in part if r[1][j] > t]
            if min(len(left), len(right)) >= min_leaf:
                got.append((round(-(impurity(part) - impurity(left) - impurity(right)), 9), j, t))
        return min(got, default=None)

    def grow(node, part, depth):
        got = None
        if len(part) >= max(min_split, 2 * min_leaf) and depth != max_depth and impurity(part) > 1e-9:
            order = sorted(range(p), key=lambda j: md5(f"{seed}:{node}:{j}"))
            got = min((b for j in order[:first] if (b := best_of(part, j))), default=None)
            got = got or next((b for j in order[first:] if (b := best_of(part, j))), None)
        out[node] = (len(part), sum(r[3] for r in part), *(got[1:] if got else (None, None)))
        if got:
            grow(node + "L", [r for r in part if r[1][got[1]] <= got[2]], depth + 1)
            grow(node + "R", [r for r in part if r[1][got[1]] > got[2]], depth + 1)

    for t in range(trees):
        bag = [(*r, sum(int(md5(f"{seed}:{t}:{r[0]}")[:8], 16) >= x for x in forest.POISSON)) for r in rows]
        grow(str(t), [r for r in bag if r[3]], 0)
    return out


def data(spark, regression):
    rng = random.Random(5)
    rows = []
    for i in range(90):
        x = (rng.randrange(12) / 4, float(rng.randrange(5)), 1.0, rng.randrange(30) / 8)
        rows.append((i, x, (x[0] * 2 - x[3] + rng.randrange(3)) if regression else "abc"[int(x[0] + x[1] / 4 + rng.random()) % 3]))
    df = spark.createDataFrame([(i, *x, y) for i, x, y in rows],
                               f"id long, a double, b double, c double, d double, y {'double' if regression else 'string'}")
    return rows, df


def shown(model):
    return {r.node: (r.n, r.weight, r.feature_pos, r.threshold) for r in model.nodes.collect()}


@pytest.mark.parametrize("local_rows", [50_000, 25])
def test_classifier_is_plain_recursion(spark, local_rows):
    rows, df = data(spark, False)
    got = forest.fit(df, list("abcd"), "y", n_estimators=4, max_features="1", min_samples_split=5, min_samples_leaf=2,
                     seed=7, local_rows=local_rows)
    want = plain_forest(rows, 4, 4, 1, "abc", 7, min_split=5, min_leaf=2)
    assert shown(got) == want and max(len(n) for n in want) > 4


def test_regressor_by_levels_and_in_one_task(spark):
    rows, df = data(spark, True)
    want = plain_forest(rows, 4, 2, 2, None, 3, max_depth=3)
    for local_rows in (50_000, 40):
        got = forest.fit(df, list("abcd"), "y", "regression", 2, max_depth=3, seed=3, local_rows=local_rows)
        assert shown(got) == want


def test_predictions_are_means_over_trees(spark):
    rows, df = data(spark, False)
    model = forest.fit(df, list("abcd"), "y", n_estimators=5, max_depth=4, seed=1)
    nodes = {r.node: r for r in model.nodes.collect()}
    out = {r.id: r for r in model.predict(df, keep=["y"]).collect()}
    assert len(out) == len(rows)
    for i, x, y in rows:
        p = [0.0] * 3
        for t in range(5):
            node = str(t)
            while nodes[node].feature_pos is not None:
                node += "L" if x[nodes[node].feature_pos] <= nodes[node].threshold else "R"
            for c in range(3):
                p[c] += nodes[node].stats[c] / nodes[node].weight / 5
        r = out[i]
        assert [r.p_a, r.p_b, r.p_c] == pytest.approx(p) and r.y == y
        assert p["abc".index(r.prediction)] == pytest.approx(max(p))
    share = {r.feature: r.importance for r in model.importance(spark).collect()}
    assert sum(share.values()) == pytest.approx(1) and share["c"] == 0 and len(share) == 4
    assert all(r.depth <= 4 for r in model.shape().collect())


def test_sizes_and_errors(spark):
    assert [forest.subset_size(m, 10) for m in ("sqrt", "log2", "all", "3", "0.5", 4)] == [3, 3, 10, 3, 5, 4]
    _, df = data(spark, False)
    for bad in ({"max_features": "11"}, {"task": "ranking"}, {"n_estimators": 0}):
        with pytest.raises(ValueError):
            forest.fit(df, list("abcd"), "y", **bad)
    one = forest.fit(df.where("y = 'a'"), list("abcd"), "y", n_estimators=2)
    assert {r.feature_pos for r in one.nodes.collect()} == {None}
    assert {r.importance for r in one.importance(spark).collect()} == {0.0}


def test_by_name(spark):
    """The registry hands every parameter on."""
    _, df = data(spark, False)
    model = search.get_model("forest")
    got = model(df, df, list("abcd"), "y", "id", n_estimators=2, min_samples_split=1000)
    assert {r.prediction for r in got.collect()} <= set("abc") and got.select("p_a").distinct().count() == 1


@pytest.mark.parametrize("local_rows", [50_000, 40])
def test_a_deep_tree_is_walked_in_one_task(spark, monkeypatch, local_rows):
    """Every level of a tree was a join; a regression's trees have dozens of levels."""
    rows, df = data(spark, True)
    model = forest.fit(df, list("abcd"), "y", "regression", 3, seed=3, local_rows=local_rows)
    assert model.nodes.agg({"depth": "max"}).first()[0] > 8
    nodes = {r.node: r for r in model.nodes.collect()}
    top = max([r.depth for r in model.rooted.collect() if r.root is None], default=-1)
    joins = []
    monkeypatch.setattr(forest, "LOCAL_ROWS", 70)
    monkeypatch.setattr(forest, "cut_lineage", lambda t, cut=forest.cut_lineage: joins.append(
        t._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(t))
    more = df.union(df.selectExpr("id + 1000", *[f"IF(id % 3 = 0, NULL, {c} + 0.01)" for c in "abcd"], "y"))
    out = {r.id: r.prediction for r in model.predict(more).collect()}
    assert max(joins) <= top + 1 and len(out) == 2 * len(rows)
    for r in more.collect():
        mean = 0.0
        for t in range(3):
            node = str(t)
            while nodes[node].feature_pos is not None:
                v = r["abcd"[nodes[node].feature_pos]]
                node += "L" if v is not None and v <= nodes[node].threshold else "R"
            mean += nodes[node].stats[0] / nodes[node].weight / 3
        assert out[r.id] == pytest.approx(mean)


@pytest.mark.parametrize("regression", [False, True])
def test_leaves_of_the_last_level_come_from_its_sums(spark, regression):
    """Their rows went to a Python worker that only counted them."""
    _, df = data(spark, regression)
    task = "regression" if regression else "classification"
    by_levels, at_once = (forest.fit(df, list("abcd"), "y", task, 3, max_depth=2, seed=5, local_rows=n) for n in (10, 50_000))
    assert by_levels.rooted.where("depth = 2 and root = node").count() == 0
    assert shown(by_levels) == shown(at_once)
    stats = lambda m: {r.node: pytest.approx(r.stats) for r in m.nodes.collect()}
    assert stats(by_levels) == {r.node: r.stats for r in at_once.nodes.collect()}
    predicted = lambda m: {r.id: r.prediction for r in m.predict(df).collect()}
    assert predicted(by_levels) == (pytest.approx(predicted(at_once)) if regression else predicted(at_once))


def test_a_bag_hashes_each_row_once_a_tree(spark):
    bag = spark.range(9).select(forest.bag_weight(42, forest.F.lit(3), forest.F.col("id")).alias("w"))
    assert bag._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    hashed = [int(md5(f"42:3:{i}")[:8], 16) for i in range(9)]
    assert [r.w for r in bag.collect()] == [sum(u >= t for t in forest.POISSON) for u in hashed]


@pytest.mark.parametrize("regression", [False, True])
def test_nodes_of_equal_size_are_split_together(spark, monkeypatch, regression):
    """A task went through its nodes one by one; rows that ask in several parts get the same."""
    from dataclasses import replace
    _, df = data(spark, regression)
    task, got = "regression" if regression else "classification", []
    calls, split = [], forest._Rule.split
    monkeypatch.setattr(forest._Rule, "split", lambda self, *a: calls.append(len(a[1])) or split(self, *a))
    for together in (128, 0, 20):
        monkeypatch.setattr(forest, "TOGETHER", together)
        rows = forest.cut_lineage(df.orderBy("id").coalesce(1))
        x = rows.selectExpr("'3' AS node", "3 AS tree", "a AS _f0", "b AS _f1", "d AS _f2",
                            "y AS _y" if regression else "CAST(ascii(y) - 97 AS DOUBLE) AS _y", "1.0D + id % 2 AS _w").toArrow()
        rule = forest._Rule(3, 0 if regression else 3, 1, None, 2, 1, 4)
        calls.clear()
        got.append(sorted(map(str, rule.finish(x).drop_columns(["place", "low", "high"]).to_pylist())))
        assert all(n > together for n in calls) and bool(calls) == (together < 90)
    assert got[0] == got[1] == got[2] and len(got[0]) > 30
    model = forest.fit(df, list("abd"), "y", task, 3, seed=3)
    want, parted = ({r.id: r.prediction for r in m.predict(df).collect()} for m in (model, replace(model, part_rows=20)))
    assert want == pytest.approx(parted)


def test_a_forest_without_depth_limit_has_no_levels(spark, monkeypatch):
    """Each level of a node of more than LOCAL_ROWS rows was a round over all rows."""
    _, df = data(spark, True)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 30)
    model = forest.fit(df, ["a"], "y", "regression", 3, seed=3)
    assert model.rooted.where("root IS NULL").count() == 0
    limited = forest.fit(df, ["a"], "y", "regression", 3, max_depth=4, seed=3)
    assert limited.rooted.where("root IS NULL").count() > 0


def test_a_missing_label_is_left_out_of_means(spark):
    """The trees whose leaf holds it count as none for a row."""
    df = spark.createDataFrame([(i, float(i), None if i == 3 else float(i)) for i in range(12)], "id long, a double, y double")
    model = forest.fit(df, ["a"], "y", "regression", 8, seed=3)
    out = {r.id: r.prediction for r in model.predict(df).collect()}
    assert not any(v is not None and v != v for v in out.values()) and sum(v is not None for v in out.values()) > 6
    gains = [r.gain for r in model.nodes.where("feature_pos IS NOT NULL").collect()]
    assert None in gains and not any(g is not None and g != g for g in gains)
