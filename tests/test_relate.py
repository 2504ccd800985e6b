"""Correlation, trend lines and VIF against numpy."""
import numpy as np
import pandas as pd
import pytest

from hourglass.operators import relate


def _data(spark, n=400, seed=7):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b = 0.8 * a + rng.normal(scale=0.5, size=n)
    c = rng.uniform(size=n) + 0.3 * b
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    return pdf, spark.createDataFrame(pdf)


def test_corr_matrix(spark):
    pdf, df = _data(spark)
    full = {(r.x, r.y): r.r for r in relate.corr_long(df, ["a", "b", "c"], full=True).collect()}
    ref = pdf.corr()
    for x in "abc":
        for y in "abc":
            assert full[(x, y)] == pytest.approx(ref.loc[x, y], abs=1e-12)
    lower = relate.corr_long(df, ["a", "b", "c"]).collect()
    assert len(lower) == 3


def test_pair_stats_and_trend_line(spark):
    pdf, df = _data(spark)
    r = relate.pair_stats(df, [("a", "b")]).first()
    k, c = np.polyfit(pdf.a, pdf.b, 1)
    assert (r.slope, r.intercept) == (pytest.approx(k, abs=1e-12), pytest.approx(c, abs=1e-12))
    line = relate.trend_line(df, "a", "b").orderBy("i").collect()
    assert len(line) == 200 and line[0].x == pytest.approx(pdf.a.min())
    assert line[-1].y_fit == pytest.approx(k * pdf.a.max() + c)


@pytest.mark.parametrize("centered", [False, True])
def test_vif_matches_least_squares(spark, centered):
    pdf, df = _data(spark)
    got = {r.feature: r.vif for r in relate.vif(df, ["a", "b", "c"], centered=centered).collect()}
    x = pdf.to_numpy()
    for i, name in enumerate("abc"):
        y, others = x[:, i], np.delete(x, i, axis=1)
        if centered:
            y = y - y.mean()
            others = others - others.mean(axis=0)
        beta, *_ = np.linalg.lstsq(others, y, rcond=None)
        resid = y - others @ beta
        r2 = 1 - resid @ resid / (y @ y)      # uncentred R^2 (no intercept) / centred after demeaning
        assert got[name] == pytest.approx(1 / (1 - r2), rel=1e-8)
        assert got[name] >= 1
