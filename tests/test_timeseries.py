"""Resample, rolling windows, decomposition and ADF against direct numpy versions."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.operators import timeseries as T
from hourglass.operators.clean import forward_fill


def test_resample_spine_and_rolling(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h, minutes=10), float(h)) for h in range(10) if h not in (3, 4)]
    rows += [("a", t0 + dt.timedelta(hours=0, minutes=50), 2.0), ("b", t0 + dt.timedelta(hours=5), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    hourly = T.resample(df, "ts", ["v"], "1 hour", keys=["k"])
    out = hourly.filter("k = 'a'").orderBy("ts").collect()
    assert len(out) == 10 and out[0].v == 1.0 and out[3].v is None and out[4].v is None
    assert hourly.filter("k = 'b'").count() == 1
    filled = forward_fill(hourly, ["v"], "ts", ["k"])
    roll = T.rolling_mean(filled, "v", "ts", 3, ["k"]).filter("k = 'a'").orderBy("ts").collect()
    assert roll[0].v_rolling is None and roll[1].v_rolling is None
    assert roll[2].v_rolling == pytest.approx((1 + 1 + 2) / 3)
    assert roll[4].v_rolling == pytest.approx((2 + 2 + 2) / 3)


def _decompose_ref(x, period):
    """Direct numpy version of the additive decomposition with trend extrapolation."""
    n = len(x)
    if period % 2:
        filt = np.ones(period) / period
    else:
        filt = np.r_[0.5, np.ones(period - 1), 0.5] / period
    h = len(filt) // 2
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        trend[i] = np.dot(filt, x[i - h:i + h + 1])
    front, back = h, n - 1 - h
    # the published rule: half-open ranges, so the last defined value is in neither line
    fl = min(front + period, back)
    k, c = np.polyfit(np.arange(front, fl), trend[front:fl], 1)
    trend[:front] = k * np.arange(front) + c
    bf = max(front, back - period)
    k, c = np.polyfit(np.arange(bf, back), trend[bf:back], 1)
    trend[back + 1:] = k * np.arange(back + 1, n) + c
    det = x - trend
    avg = np.array([np.nanmean(det[i::period]) for i in range(period)])
    avg -= avg.mean()
    seasonal = np.tile(avg, n // period + 1)[:n]
    return trend, seasonal, det - seasonal


@pytest.mark.parametrize("period,block,chunk", [(7, None, "30 days"), (4, None, "30 days"), (7, 9, "4 days"),
                                                (4, 8, "3 days")])
def test_decomposition_matches_reference(spark, period, block, chunk):
    rng = np.random.default_rng(11)
    n = 60
    x = 10 + 0.3 * np.arange(n) + np.tile([3, -1, 0, 2, -2, 1, -3], 9)[:n] + rng.normal(scale=0.2, size=n)
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"day": days, "y": x}))
    out = T.seasonal_decompose(df, "y", "day", period, block=block, chunk=chunk).orderBy("day").toPandas()
    trend, seasonal, resid = _decompose_ref(x, period)
    assert np.allclose(out.trend, trend, atol=1e-9)
    assert np.allclose(out.seasonal, seasonal, atol=1e-9)
    assert np.allclose(out.observed, out.trend + out.seasonal + out.resid, atol=1e-9)
    assert abs(seasonal[:period].sum()) < 1e-9


def _adf_ref(x, maxlag):
    """statsmodels-style ADF: common-sample AIC search, refit, t of the level term."""
    dx = np.diff(x)
    n = len(x)

    def design(p, start):
        rows = range(start, n - 1)          # index into dx
        X = [[1.0, x[j]] + [dx[j - i] for i in range(1, p + 1)] for j in rows]
        return np.array(X), dx[list(rows)]

    best = None
    for p in range(maxlag + 1):
        X, y = design(p, maxlag)
        beta, *_ = np.linalg.lstsq(X, y, rcond=None)
        ssr = float(((y - X @ beta) ** 2).sum())
        nobs = len(y)
        aic = nobs * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    X, y = design(p, p)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - X.shape[1])
    cov = s2 * np.linalg.inv(X.T @ X)
    return beta[1] / math.sqrt(cov[1, 1]), p, len(y)


@pytest.mark.parametrize("kind,block", [("walk", None), ("noise", None), ("ar", None), ("ar", 23), ("walk", 40)])
def test_adf_matches_direct_ols(spark, kind, block):
    rng = np.random.default_rng({"walk": 1, "noise": 2, "ar": 3}[kind])
    n = 300
    e = rng.normal(size=n)
    if kind == "walk":
        x = np.cumsum(e) + 100
    elif kind == "noise":
        x = e + 5
    else:
        x = np.zeros(n)
        for i in range(2, n):
            x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + e[i]
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"t": t, "x": x}))
    r = T.adf_test(df, "x", "t", block=block, chunk="1 day").first()
    maxlag = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    stat, p, nobs = _adf_ref(x, maxlag)
    assert r.used_lag == p and r.nobs == nobs
    assert r.adf_stat == pytest.approx(stat, rel=1e-7)
    if kind == "walk":
        assert r.p_value > 0.05 and r.stationary == 0
    else:
        assert r.p_value < 0.05 and r.stationary == 1


def test_adf_per_key_equals_single(spark):
    rng = np.random.default_rng(9)
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(120)]
    pdf = pd.concat([pd.DataFrame({"k": k, "t": t, "x": rng.normal(size=120).cumsum()}) for k in "ab"])
    df = spark.createDataFrame(pdf)
    keyed = {r.k: r.adf_stat for r in T.adf_test(df, "x", "t", keys=["k"]).collect()}
    for k in "ab":
        single = T.adf_test(df.filter(f"k = '{k}'").drop("k"), "x", "t").first().adf_stat
        assert keyed[k] == pytest.approx(single, rel=1e-9)


def test_chunked_rolling_and_ffill_equal_unchunked(spark):
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2024, 1, 1)
    n = 24 * 40
    vals = rng.normal(size=n)
    vals[rng.random(n) < 0.3] = np.nan
    vals[:30] = np.nan                       # leading gap: stays NULL after the fill
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], n // 2),
                        "ts": [t0 + dt.timedelta(hours=i % (n // 2)) for i in range(n)], "v": vals})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    a = forward_fill(df, ["v"], "ts", ["k"])
    b = T.forward_fill_chunked(df, ["v"], "ts", ["k"], chunk="2 days")
    key = lambda d: d.orderBy("k", "ts").toPandas()
    pd.testing.assert_frame_equal(key(a), key(b))
    ra = T.rolling_mean(a, "v", "ts", 24, ["k"])
    rb = T.rolling_mean(a, "v", "ts", 24, ["k"], freq="1 hour", chunk="3 days")
    pd.testing.assert_frame_equal(key(ra), key(rb))
    g = T.rolling_mean(a.filter("k = 'a'").drop("k"), "v", "ts", 24, freq="1 hour", chunk="2 days")
    assert g.count() == n // 2
