"""Linear models and learning curves from sums of products."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hourglass.operators import ml
from hourglass.operators.linear import GramRegression, fold_plan, linear_learning_curve, row_ranks


def _data(n=301, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) @ np.array([[1, .6, 0, 0], [0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]])
    return x, x @ [1.5, -0.7, 0.02, 0.0] + 3 + r.normal(size=n)


def _frame(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), **{c: x[:, i] for i, c in enumerate("abcd")}, "label": y}))


def _fit(x, y, kind, alpha):
    """Reference solutions in numpy; the lasso by long proximal steps."""
    m, xc, yc = x.mean(axis=0), x - x.mean(axis=0), y - y.mean()
    if kind == "lasso":
        w, step = np.zeros(x.shape[1]), len(y) / np.linalg.eigvalsh(xc.T @ xc)[-1]
        for _ in range(20_000):
            g = w + step * xc.T @ (yc - xc @ w) / len(y)
            w = np.sign(g) * np.maximum(abs(g) - step * alpha, 0)
    else:
        w = np.linalg.solve(xc.T @ xc + (alpha if kind == "ridge" else 0) * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - w @ m, w


@pytest.mark.parametrize("kind, alpha", [("linear", 0.0), ("ridge", 3.0), ("lasso", 0.05)])
def test_coefficients_and_saving(spark, tmp_path, kind, alpha):
    x, y = _data()
    df = _frame(spark, x, y)
    bad = spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0, 1.0), (902, 1.0, 1.0, 1.0, 1.0, None)], df.schema)
    model = GramRegression("abcd", kind=kind, alpha=alpha).fit(df.unionByName(bad))
    b, w = _fit(x, y, kind, alpha)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-9) and model.intercept == pytest.approx(b, abs=1e-9)
    path = str(tmp_path / "m")
    ml.save_model(PipelineModel([model]), path)
    got = [r.prediction for r in ml.load_model(path).transform(df).orderBy("id").collect()]
    assert got == pytest.approx(list(x @ w + b))


def test_lasso_equals_sparks_own_fit(spark):
    x, y = _data(500, 3)
    df = _frame(spark, x, y)
    base = ml.feature_stages(df, list("abcd"))
    mine = Pipeline(stages=base + ml.regressors(500, 1.0, list("abcd"))["Lasso Regression"]).fit(df).stages[-1]
    theirs = Pipeline(stages=base + [LinearRegression(regParam=ml.LASSO_ALPHA, elasticNetParam=1.0, maxIter=5000, tol=1e-14,
                                                      standardization=False)]).fit(df).stages[-1]
    assert mine.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=1e-8)
    assert mine.intercept == pytest.approx(theirs.intercept, abs=1e-8)


def test_features_that_say_the_same(spark):
    x, y = _data(50, 4)
    x[:, 1] = 2 * x[:, 0]
    x[:, 2] = 7.0
    df = _frame(spark, x, y)
    model = GramRegression("abcd").fit(df)
    want = np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0]
    assert [r.prediction for r in model.transform(df).orderBy("id").collect()] == pytest.approx(list(np.column_stack([np.ones(50), x]) @ want))


def test_folds_are_stretches_of_rows():
    assert [(f, a, b, k, p) for f, a, b, k, p in fold_plan(10, 3, [0.5, 1.0])] == [
        (0, 0, 4, 3, [(4, 7)]), (0, 0, 4, 6, [(4, 10)]), (1, 4, 7, 3, [(0, 3)]), (1, 4, 7, 6, [(0, 4), (7, 9)]),
        (2, 7, 10, 3, [(0, 3)]), (2, 7, 10, 6, [(0, 6)])]


def test_row_ranks(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(700))).repartition(7)
    got = [(r.v, r["id"]) for r in row_ranks(df, ["v", "id"]).orderBy("rank").collect()]
    assert got == sorted(got)
    assert [r["rank"] for r in row_ranks(df, ["v", "id"]).orderBy("rank").select("rank").collect()] == list(range(5000))


@pytest.mark.parametrize("kind, alpha", [("linear", 0.0), ("ridge", 5.0), ("lasso", 0.05)])
def test_learning_curve_equals_single_fits(spark, kind, alpha):
    x, y = _data(100, 5)
    sizes, df = [0.2, 0.55, 1.0], _frame(spark, x, y)
    got = {r.n_train: r for r in linear_learning_curve(df.repartition(5), list("abcd"), "label", ["id"], kind, alpha, sizes=sizes).collect()}
    cuts, want = [(0, 34), (34, 67), (67, 100)], {}
    for a, b in cuts:
        rest = np.r_[0:a, b:100]
        for k in [int(s * 66) for s in sizes]:
            i, w = _fit(x[rest[:k]], y[rest[:k]], kind, alpha)
            r2 = lambda p: 1 - ((y[p] - i - x[p] @ w) ** 2).sum() / ((y[p] - y[p].mean()) ** 2).sum()
            want.setdefault(k, []).append((r2(rest[:k]), r2(np.arange(a, b))))
    assert got.keys() == want.keys()
    for k, v in want.items():
        v = np.array(v)
        assert (got[k].train_r2_mean, got[k].test_r2_mean) == pytest.approx(tuple(v.mean(axis=0)), abs=1e-8)
        assert (got[k].train_r2_std, got[k].test_r2_std) == pytest.approx(tuple(v.std(axis=0)), abs=1e-8)
    if kind == "linear":                                       # the general way, by fits, says the same
        fits = ml.learning_curve(df, lambda tr: [GramRegression("abcd")], ["id"], sizes=sizes)
        assert {r.n_train: r.test_r2_mean for r in fits.collect()} == pytest.approx({k: r.test_r2_mean for k, r in got.items()})
