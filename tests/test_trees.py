"""Exact trees and grown forests against an exhaustive search."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hourglass.operators import ml, trees


def _exhaustive(x, y, w=None, max_depth=99):
    """{path: (feature, threshold) or (mean, rows)} by trying every threshold of every feature."""
    w, out = np.ones(len(y)) if w is None else w, {}

    def go(r, path):
        n, spread = w[r].sum(), y[r].max() - y[r].min()
        tried = []
        m = y[r] - np.average(y[r], weights=w[r])
        if spread > 0 and len(path) < max_depth:
            for f in range(x.shape[1]):
                values = np.unique(x[r, f])
                for a, b in zip(values, values[1:]):
                    left = x[r, f] <= a
                    s, k = (w[r] * m)[left].sum(), w[r][left].sum()
                    tried.append((s * s / k + s * s / (n - k), f, a + (b - a) / 2))
        if not tried:
            out[path] = (np.average(y[r], weights=w[r]), n)
            return
        top = max(t[0] for t in tried)
        _, f, t = next(c for c in tried if c[0] >= top - 1e-9 * top - 1e-13 * n * spread ** 2)
        out[path] = (f, t)
        go(r[x[r, f] <= t], path + "L")
        go(r[x[r, f] > t], path + "R")

    go(np.arange(len(y)), "")
    return out


def _paths(tree):
    out, todo = {}, [(0, "")]
    for i, path in todo:
        if tree.feature[i] < 0:
            out[path] = (tree.value[i], tree.rows[i])
        else:
            out[path] = (tree.feature[i], tree.threshold[i])
            todo += [(tree.left[i], path + "L"), (tree.right[i], path + "R")]
    return out


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9)


def _table(kind, n=400, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 1)                      # many equal values: ranges part them
    x[: n // 3, 0] = 0.5                                         # a third of the rows share one
    noise = np.round(x[:, 0] * x[:, 1] + r.normal(size=n), 2)
    return x, noise if kind == "regression" else (noise > 0.3).astype(float)


def _frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")


@pytest.mark.parametrize("kind", ["regression", "classes"])
def test_growing_in_memory_equals_an_exhaustive_search(kind):
    x, y = _table(kind)
    _same(_paths(trees.grow(x, y, np.ones(len(y)))), _exhaustive(x, y))
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float)
    _same(_paths(trees.grow(x, y, w, max_depth=4)), _exhaustive(x, y, w, 4))


@pytest.mark.parametrize("kind", ["regression", "classes"])
def test_exact_tree_equals_an_exhaustive_search(spark, kind):
    x, y = _table(kind, 300, 2)
    df = _frame(spark, x, y).repartition(3)
    model = trees.ExactTree("abc", max_depth=4, classes=kind == "classes", range_rows=60).fit(df)
    _same(_paths(model.tree), _exhaustive(x, y, max_depth=4))
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    got = {r["id"]: r.prediction for r in model.transform(df).collect()}
    mean = np.array(model.tree.value)[trees.descend(x, *model.tree.arrays())]
    assert [got[i] for i in range(len(y))] == pytest.approx(list((mean > 0.5).astype(float) if kind == "classes" else mean))


def test_rows_that_are_not_learned_from(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, 5.0), (float("nan"), 5.0), (float("inf"), 5.0), (1.5, None), (1.5, float("nan"))],
                               "a double, label double")
    model = trees.ExactTree(["a"]).fit(df)
    assert _paths(model.tree) == {"": (0, 1.5), "L": (1.0, 1.0), "R": (3.0, 1.0)}
    assert [r.prediction for r in model.transform(df).collect()] == [1.0, 3.0, 3.0, 3.0, 3.0, 1.0, 1.0]
    assert _paths(trees.ExactTree(["a"]).fit(df.where("a = 1")).tree) == {"": (1.0, 1.0)}


def test_leaves_are_pure_where_thirty_levels_are_too_few(spark):
    x = np.array([[float(i // 5), 0.0, 0.0] for i in range(400)])
    y = np.array([4.0 ** (i // 5) for i in range(400)])                   # the largest are parted one after another
    df = _frame(spark, x, y)
    model = trees.GrownForest("abc", keys=["id"], n_trees=1, sampled=False, hand_over=300).fit(df)
    sub = model.subtrees.collect()
    deepest = max(trees.Nodes(*[list(r[c]) for c in ("feature", "threshold", "left", "right", "value", "rows", "gain")]).depth() for r in sub)
    assert len(sub) > 1 and deepest > ml.MAX_FOREST_DEPTH
    assert model.transform(df).where(F.col("prediction") != F.col("label")).count() == 0


def test_a_point_too_hot_to_hand_over_is_a_leaf(spark):
    x = np.concatenate([np.full((300, 3), 0.5), np.random.default_rng(3).normal(size=(200, 3))])
    y = np.concatenate([np.arange(300) % 2, np.arange(200)]).astype(float)
    df = _frame(spark, x, y)
    model = trees.GrownForest("abc", keys=["id"], n_trees=1, sampled=False, hand_over=100, bins=4).fit(df)
    rows = model.transform(df).collect()
    assert all(r.prediction == pytest.approx(0.5 if r["id"] < 300 else r.label) for r in rows)


def test_forest_does_not_hang_on_partitions_and_survives_saving(spark, tmp_path):
    x, y = _table("classes", 300, 4)
    df = _frame(spark, x, y)
    fit = lambda d: trees.GrownForest("abc", keys=["id"], n_trees=6, classes=True, tried="sqrt", hand_over=80).fit(d)
    one, other = fit(df.repartition(1)), fit(df.repartition(5))
    score = lambda m: [r.probability[1] for r in m.transform(df).orderBy("id").collect()]
    first = score(one)
    assert score(other) == pytest.approx(first)
    assert one.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray())
    drawn = {r.tree: r.rows for r in one.shape().collect()}
    ids = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    assert drawn == {t: trees.bootstrap(ids, t, 42).sum() for t in range(6)}
    path = str(tmp_path / "model")
    ml.save_model(PipelineModel([one, trees.ExactTree("abc").fit(df.withColumn("label", F.col("label") + 1))]), path)
    again = ml.load_model(path)
    assert score(again.stages[0]) == pytest.approx(first)
    assert _paths(again.stages[1].tree) == _paths(trees.ExactTree("abc").fit(df.withColumn("label", F.col("label") + 1)).tree)


def test_bootstrap_draws_about_each_row_once():
    w = trees.bootstrap(np.arange(200_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_sets_grown_together_are_the_trees_grown_alone():
    x, y = _table("classes", 600, 5)
    w, place = np.random.default_rng(6).integers(1, 4, len(y)).astype(float), np.random.default_rng(7).integers(0, 3, len(y))
    y[place == 1] = 1.0                                                   # a pure set among the others
    found = trees.grow_all(x, y, w, place, [3, 4, 5], tried=2)
    for i, g in enumerate(found):
        r = place == i
        alone = trees.grow(x[r], y[r], w[r], tried=2, seed=3 + i)
        assert (g.feature, g.threshold, g.left, g.right) == (alone.feature, alone.threshold, alone.left, alone.right)
        assert g.value == pytest.approx(alone.value) and g.rows == alone.rows and g.gain == pytest.approx(alone.gain)


def test_cells_of_many_nodes_are_summed_without_a_pass_for_each(spark):
    """A level of upper nodes: the work of a task hangs on its rows, not on rows x nodes."""
    r = np.random.default_rng(8)
    x, y = np.round(r.normal(size=(500, 3)), 1), r.integers(0, 2, 500).astype(float)
    forest, tree = trees.GrownForest("abc", keys=["id"], n_trees=1, sampled=False, bins=4), trees.Nodes()
    level = tree.split_all(np.array([0]), np.array([0]), np.array([0.0]), np.array([1.0]))
    level = tree.split_all(level, np.array([1, 2]), np.array([0.0, 0.3]), np.array([1.0, 1.0])).tolist()
    edges, own = [np.array([-0.5, 0.0, 0.5])] * 3, {(0, level[1]): [(-3.0, 3.0)] * 3}
    rows = trees._learned(_frame(spark, x, y), "abc", "label", ["id"])
    got = {(c["node"], c["feature"], c["bin"]): (c["n"], c["s"], c["x_low"], c["x_high"], c["low"], c["high"])
           for c in forest._cells(rows, {0: tree}, {0: level}, edges, own).collect()}
    at, want = trees.descend(x, *tree.arrays()), {}
    for node in level:
        for f in range(3):
            v, t = x[at == node, f], y[at == node]
            code = np.minimum((4 * ((v + 3) / 6)).astype(int), 3) if node == level[1] else np.searchsorted(edges[f], v)
            for b in np.unique(code):
                k = code == b
                want[node, f, b] = (k.sum(), t[k].sum(), v[k].min(), v[k].max(), t[k].min(), t[k].max())
    assert got == want
    cells = trees._cell_sums(np.array([7, 2, 7]), 1 << 40, np.array([1.0, 2.0, 1.0]), np.array([1.0, 2.0, 3.0]), np.array([0.0, 1.0, 1.0]))
    assert [c.tolist() for c in cells] == [[2, 7], [2.0, 2.0], [2.0, 1.0], [2.0, 1.0], [2.0, 3.0], [1.0, 0.0], [1.0, 1.0]]


def test_attribute_lists_are_cut_into_no_more_ranges_than_writers_keep_off_memory(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), float(i % 3)) for i in range(150)], "a double, b double, label double")
    tree = trees.ExactTree(["a", "b"], range_rows=1)
    lists = tree._lists(trees._learned(rows, tree.inputs, "label"))
    assert lists.rdd.getNumPartitions() == 200 and lists.count() == 300


def test_rows_are_sorted_once_however_deep_the_tree(monkeypatch):
    x = np.array([[float(i // 5), float(i % 3)] for i in range(400)])
    y = np.array([4.0 ** (i // 5) for i in range(400)])                   # the largest are parted one after another: about 80 levels
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sizes.append(np.size(a)) or sort(a, *args, **kw))
    tree = trees.grow(x, y, np.ones(400))
    assert tree.depth() > 70 and sum(sizes) <= 2 * x.size + 2 * len(tree.feature)


@pytest.mark.parametrize("branch_rows", [0, 32])
def test_rows_are_routed_to_wanted_leaves_alone(monkeypatch, branch_rows):
    monkeypatch.setattr(trees, "BRANCH_ROWS", branch_rows)
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(300, 3)), 1)
    tree = trees.grow(x, r.random(300), np.ones(300), max_depth=5)
    leaves = np.flatnonzero(np.array(tree.feature) < 0)
    wanted = np.zeros(len(tree.feature), bool)
    wanted[leaves[::3]] = True
    own, at = np.arange(0, 300, 2), trees.descend(x, *tree.arrays())
    rows, leaf = trees.routed(np.ascontiguousarray(x.T), own, tree.arrays(), wanted)
    assert sorted(rows) == [i for i in own if wanted[at[i]]] and (at[rows] == leaf).all()
    assert [len(v) for v in trees.routed(x.T, own, tree.arrays(), np.zeros(len(wanted), bool))] == [0, 0]
    assert [len(v) for v in trees.routed(np.zeros((0, 0)), np.arange(0), tree.arrays(), wanted)] == [0, 0]


def test_attribute_lists_reach_the_scans_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 200)
    x, y = _table("regression", 300, 10)
    tree = trees.ExactTree("abc", range_rows=100)
    lists = tree._lists(trees._learned(_frame(spark, x, y).repartition(3), tree.inputs, "label")).persist()
    blocks = trees._blocks(lists, 3).toArrow()
    assert blocks.num_rows <= 900 // (200 // 3) + 2 * lists.rdd.getNumPartitions()
    got = sorted((int(f), v, t, *p) for b in trees._entries(blocks.to_batches()) for f, v, t, p in zip(*b))
    assert got == sorted((f, p[f], t, *p) for p, t in zip(x.tolist(), y.tolist()) for f in range(3))
    lists.unpersist()


def test_forest_rows_are_dealt_in_blocks(spark):
    """A set of rows reaches its task as blocks of bytes, each set as a task of its own."""
    x, y = _table("regression", 300, 11)
    key, n, (ids, points) = trees._by_key(np.arange(300) % 3, np.arange(300), x)
    assert key.tolist() == [0, 1, 2] and n.tolist() == [100] * 3
    table = pa.table([ids, points], names=["id", "x"])
    assert trees._unpacked(table, "id", np.int64).tolist() == [i for j in range(3) for i in range(j, 300, 3)]
    assert (trees._unpacked(table, "x", float).reshape(300, 3) == np.concatenate([x[j::3] for j in range(3)])).all()
    assert [len(v) for v in trees._by_key(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, 3)))] == [0, 0, 2]
    rows = trees._learned(_frame(spark, x, y), "abc", "label", ["id"])
    alone = {t: trees.Nodes(rows=[300.0]) for t in range(40)}
    parts = trees.GrownForest("abc", keys=["id"], n_trees=40, sampled=False)._finish(rows, alone, {t: [0] for t in alone})
    assert parts.rdd.getNumPartitions() == 40 and sorted((r.tree, r.rows[0]) for r in parts.collect()) == [(t, 300.0) for t in range(40)]


@pytest.mark.parametrize("tried", [None, 2])
def test_sums_of_cells_and_of_ordered_rows_give_the_same_tree(monkeypatch, tried):
    x, y = _table("regression", 600, 12)
    x[:, 1], w = np.floor(3 * x[:, 1]), np.random.default_rng(13).integers(1, 4, 600).astype(float)
    found = []
    for cells in (0, 2, 1e9):                                             # ordered rows alone, both, cells alone
        monkeypatch.setattr(trees, "CELLS_A_ROW", cells)
        found.append(trees.grow(x, y, w, tried=tried, seed=5))
    for g in found[1:]:
        assert (g.feature, g.threshold, g.left, g.right, g.rows) == (found[0].feature, found[0].threshold, found[0].left, found[0].right, found[0].rows)
        assert g.value == pytest.approx(found[0].value) and g.gain == pytest.approx(found[0].gain)
