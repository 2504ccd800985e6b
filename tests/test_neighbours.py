"""Exact k nearest neighbours by pivot cells, against brute force."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from hourglass.operators import ml
from hourglass.operators.neighbours import PivotIndex, cells_in_reach, distances, nearest_neighbours, vote

SMALL = {"cell_rows": 40, "inner": 5, "pivots": 8}


def _brute(x, q, k=7):
    out = []
    for a in q:
        d = np.zeros(len(x))
        for c in range(x.shape[1]):
            d += (x[:, c] - a[c]) ** 2
        out.append([(int(i), float(np.sqrt(d[i]))) for i in np.lexsort((np.arange(len(x)), d))[:k]])
    return out


def _found(spark, x, q, k=7, **params):
    points = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, y double").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "ask long, v array<double>")
    near, work = nearest_neighbours(points, asked.withColumnRenamed("ask", "name"), "v", "id", "y", k=k, **params)
    got = [[] for _ in q]
    for r in near.orderBy("name", "rank").collect():
        got[r["name"]].append((r["id"], r["distance"]))
    return got, work.agg(F.sum("n_compared")).first()[0]


def _clusters():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 4)) * 10
    return [centres[r.integers(12, size=n)] + r.normal(size=(n, 4)) for n in (1500, 120)]


def _grid():
    r = np.random.default_rng(2)
    return [np.round(r.normal(size=(n, 2)), 1) for n in (1200, 150)]


def _hot():
    r = np.random.default_rng(3)
    return [np.concatenate([np.full((n, 3), 0.25), r.normal(size=(m, 3))]) for n, m in ((700, 400), (60, 60))]


@pytest.mark.parametrize("shape", [_clusters, _grid, _hot])
def test_equal_to_brute_force_on_clustered_tied_and_hot_points(spark, shape):
    x, q = shape()
    got, compared = _found(spark, x, q, **SMALL)
    assert got == _brute(x, q)
    assert compared < len(x) * len(q) / 4                       # most cells are ruled out


def test_default_cells_and_fewer_points_than_k(spark):
    r = np.random.default_rng(4)
    x, q = r.normal(size=(5, 3)), r.normal(size=(4, 3))
    assert _found(spark, x, q)[0] == _brute(x, q)
    assert _found(spark, x, q, k=1)[0] == _brute(x, q, 1)


def test_points_that_take_no_part(spark):
    schema = "id long, v array<double>, y double"
    points = spark.createDataFrame([(1, [0.0, 0.0], 1.0), (2, [1.0, None], 1.0), (3, [float("nan"), 0.0], 1.0), (4, None, 0.0), (None, [0.0, 0.1], 0.0),
                                    (5, [float("inf"), 0.0], 0.0)], schema)
    asked = spark.createDataFrame([(7, [0.0, 3.0]), (8, None), (9, [None, 1.0])], "name long, v array<double>")
    near, _ = nearest_neighbours(points, asked, "v", "id", "y")
    assert [(r["name"], r["id"], r["distance"]) for r in near.collect()] == [(7, 1, 3.0)]
    none, _ = nearest_neighbours(points.limit(0), asked, "v", "id", "y")
    assert none.count() == 0


def test_vote_breaks_ties_to_the_smallest_label(spark):
    near = spark.createDataFrame([(1, 1.0, 0.5), (1, 0.0, 0.5), (2, 3.0, 0.0), (2, 1.0, 1.0), (2, 1.0, 1.0)], "q long, label double, distance double")
    rows = {r.q: r for r in vote(near, ["q"]).collect()}
    assert (rows[1].prediction, rows[1].confidence, rows[2].prediction) == (0.0, 0.5, 1.0)
    assert {r.q: r.prediction for r in vote(near, ["q"], weights="distance").collect()}[2] == 3.0


def test_no_cell_in_reach_is_ruled_out():
    r = np.random.default_rng(5)
    x, q, p = r.normal(size=(400, 3)), r.normal(size=(50, 3)), r.normal(size=(20, 3))
    far = distances(x, p)
    cell = far.argmin(axis=1)
    own = far[np.arange(len(x)), cell]
    low, high = (np.array([f(own[cell == c], initial=s) for c in range(20)]) for f, s in ((np.min, np.inf), (np.max, -np.inf)))
    d, reach = distances(q, p), np.sort(distances(q, x), axis=1)[:, 6]
    kept = cells_in_reach(d, reach, low, high, distances(p, p), d.argmin(axis=1))
    near = distances(q, x) <= reach[:, None]
    assert all(kept[i, cell[j]] for i, j in zip(*np.nonzero(near))) and kept.mean() < 0.9


def test_classifier_in_a_pipeline(spark):
    r = np.random.default_rng(6)
    a, b = r.normal(size=900), r.uniform(-1, 1, 900)
    y = ((a ** 2 + b ** 2) > 1).astype(float)
    df = spark.createDataFrame([(int(i), float(u), float(v), float(w)) for i, (u, v, w) in enumerate(zip(a, b, y))], "id long, a double, b double, label double")
    train, test = ml.hash_split(df, ["id"])
    stages = ml.feature_stages(train, ["a", "b"]) + ml.classifiers(train.count(), ["a", "b"])["KNN"]
    pred = Pipeline(stages=stages).fit(train).transform(test)
    got = {r["id"]: (r.prediction, r.probability[1]) for r in pred.collect()}
    x, q = (np.array([(r.a, r.b) for r in d.orderBy("id").collect()]) for d in (train, test))
    labels = np.array([r.label for r in train.orderBy("id").collect()])
    mean, std = x.mean(axis=0), x.std(axis=0)
    want = [labels[[i for i, _ in n]].mean() for n in _brute((x - mean) / std, (q - mean) / std)]
    assert [got[r["id"]][1] for r in test.orderBy("id").collect()] == pytest.approx(want)
    assert ml.fit_one("KNN", stages, train, test, "classification").metrics["accuracy"] > 0.9


def test_where_no_cell_is_ruled_out_an_asked_point_is_sent_once_to_a_group(spark):
    r = np.random.default_rng(7)
    x, q = r.normal(size=(900, 40)), r.normal(size=(30, 40))
    points = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, x array<double>, label double")
    asked = spark.createDataFrame([(i, v.tolist(), float("inf")) for i, v in enumerate(q)], "ask long, x array<double>, reach double")
    index = PivotIndex(points, 7, cell_rows=100)
    cells, groups = int((index.pivots.rows > 0).sum()), index.groups.max() + 1
    assert groups <= 4 and cells > 20
    assert index._routed(asked, False).count() <= len(q) * groups       # was a copy of the point for every cell
    got, _ = _found(spark, x, q, cell_rows=100)
    assert got == _brute(x, q)
