"""Welch test, normality sampling and QQ ranks."""
import math

import numpy as np
import pandas as pd
import pytest

from hourglass.functions.distributions import norm_ppf, t_two_sided_p
from hourglass.operators import hypothesis as H


def test_welch_against_formulas(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(1.0, 1.0, 300), rng.normal(1.3, 2.0, 120)
    pdf = pd.DataFrame({"flag": [0] * 300 + [1] * 120, "v": np.r_[a, b]})
    r = H.welch_test(spark.createDataFrame(pdf), "v", "flag").first()
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    assert r.t_stat == pytest.approx(t, rel=1e-10) and r.dof == pytest.approx(dof, rel=1e-10)
    assert r.p_value == pytest.approx(t_two_sided_p(abs(t), dof), rel=1e-9)
    d = (b.mean() - a.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert r.cohens_d == pytest.approx(d, rel=1e-10)
    assert r.ci_lo == pytest.approx(b.mean() - a.mean() - 1.96 * math.sqrt(va + vb), rel=1e-10)
    table = H.decision_table(H.welch_test(spark.createDataFrame(pdf), "v", "flag")).collect()
    assert len(table) == 10 and table[0].metric == "method"


def test_jarque_bera(spark):
    rng = np.random.default_rng(8)
    x = rng.exponential(size=2000)
    r = H.jarque_bera(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first()
    m = x - x.mean()
    g1 = (m ** 3).mean() / (m ** 2).mean() ** 1.5
    g2 = (m ** 4).mean() / (m ** 2).mean() ** 2 - 3
    jb = len(x) / 6 * (g1 ** 2 + g2 ** 2 / 4)
    assert r.jb == pytest.approx(jb, rel=1e-9) and r.normal == 0


def test_hash_sample_deterministic_and_bounded(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(5000), "x": rng.normal(size=5000), "y": rng.integers(0, 3, 5000)})
    df = spark.createDataFrame(pdf)
    s1 = H.hash_sample(df.repartition(1), ["x", "y"], size=200).toPandas()
    s2 = H.hash_sample(df.repartition(9), ["x", "y"], size=200).toPandas()
    assert s1.groupby("column").size().tolist() == [200, 200]
    key = lambda s: sorted(zip(s.column, s.x))
    assert key(s1) == key(s2)
    small = H.hash_sample(df.limit(50), ["x"], size=200).count()
    assert small == 50


def test_shapiro_test_rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(3000), "n": rng.normal(size=3000), "e": rng.exponential(size=3000)})
    out = {r.column: r for r in H.shapiro_test(spark.createDataFrame(pdf), ["n", "e"]).collect()}
    assert out["n"].n_sample == 500 and out["e"].normal == 0 and out["e"].shape == "Right-skewed"


def test_qq_points_ranks(spark):
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(size=700), np.full(300, 0.5)]       # a heavily repeated value
    pdf = pd.DataFrame({"id": np.arange(len(x)), "x": x})
    pts = H.qq_points(spark.createDataFrame(pdf).repartition(5), "x", partitions=6).orderBy("i").toPandas()
    n = len(x)
    assert pts.i.tolist() == list(range(1, n + 1))
    assert np.allclose(pts.osr, np.sort(x))
    v = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    v[-1] = 0.5 ** (1 / n)
    v[0] = 1 - v[-1]
    assert np.allclose(pts.osm, norm_ppf(v), atol=5e-9)
    fit = H.qq_fit(spark.createDataFrame(pts)).first()
    k, c = np.polyfit(norm_ppf(v), np.sort(x), 1)
    assert fit.slope == pytest.approx(k, rel=1e-6) and fit.intercept == pytest.approx(c, rel=1e-6)


def test_qq_grid_close_to_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 20000)
    pts = H.qq_grid(spark.createDataFrame(pd.DataFrame({"x": x})), "x", points=200).orderBy("i").toPandas()
    assert len(pts) == 200
    exact = np.quantile(x, pts.p, method="inverted_cdf")
    assert np.max(np.abs(pts.osr - exact)) < 0.05          # sketch rank error <= n / accuracy
    assert np.allclose(pts.osm, norm_ppf(pts.p.to_numpy()), atol=5e-9)
