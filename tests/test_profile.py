"""Quantiles, describe, histograms and box plots against numpy/pandas."""
import numpy as np
import pandas as pd
import pytest

from hourglass.operators import profile as prof
from hourglass.operators import quantiles as Q


def _frame(spark, values, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: values}))


@pytest.mark.parametrize("method", ["exact", "select"])
def test_quantiles_match_numpy(spark, method, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.integers(0, 5, 500).astype(float)])
    df = _frame(spark, x).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    monkeypatch.setattr(Q, "WINDOW_LIMIT", 50)   # force the narrowing recursion
    got = Q.quantiles(df, ["x"], probs, method)["x"]
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]), rtol=0, atol=1e-12)


def test_median_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    assert Q.medians(df, ["x"])["x"] == 3.0


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.exponential(size=500)})
    out = {r.column: r for r in prof.describe(spark.createDataFrame(pdf)).collect()}
    ref = pdf.describe()
    for c in "ab":
        assert out[c]["count"] == 500
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
            assert out[c][ours] == pytest.approx(ref.loc[theirs, c], rel=1e-10, abs=1e-12)
    sk = {r.column: r.skew for r in prof.skewness(spark.createDataFrame(pdf)).collect()}
    assert sk["b"] == pytest.approx(pdf["b"].skew(), rel=1e-9)


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=997),
    np.array([0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 1.0]),
    np.full(10, 2.5),
    np.linspace(-1, 1, 41),
])
def test_histogram_matches_numpy(spark, values):
    out = prof.histogram(_frame(spark, values), "x", bins=40).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=40)
    assert [r["count"] for r in out] == counts.tolist()
    assert np.allclose([r.bin_lo for r in out], edges[:-1])


def test_density_histogram_per_key(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 300), "x": np.r_[rng.normal(size=300), rng.uniform(size=300)]})
    out = prof.histogram(spark.createDataFrame(pdf), "x", bins=40, keys=["g"], density=True).collect()
    for g in "ab":
        rows = sorted([r for r in out if r.g == g], key=lambda r: r.bin)
        dens, _ = np.histogram(pdf.x[pdf.g == g], bins=40, density=True)
        assert np.allclose([r.density for r in rows], dens)


def test_boxplot_whiskers(spark):
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 40, -30], dtype=float)
    r = prof.boxplot_stats(_frame(spark, x), "x").first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    inside = x[(x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)]
    assert (r.q1, r.median, r.q3) == (q1, med, q3)
    assert (r.whisker_lo, r.whisker_hi, r.fliers) == (inside.min(), inside.max(), 2)


def test_missing_profile_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 1.0), (3, None, 2.0), (None, 1.0, 3.0)],
                               "a int, b double, c double")
    out = {r.column: r for r in prof.missing_profile(df).collect()}
    assert (out["a"].missing, out["a"].missing_pct, out["a"].action) == (1, 25.0, "impute_median")
    assert (out["b"].missing_pct, out["b"].action, out["b"].over_threshold) == (75.0, "drop", 1)
    assert prof.sparse_columns(df) == ["b"]


def test_value_counts_and_uplift(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0), (1, 6.0)], "f int, v double")
    vc = {r.f: r for r in prof.value_counts(df, "f").collect()}
    assert vc[0]["count"] == 2 and vc[0].share_pct == 50.0
    u = prof.uplift(df, "f", "v").first()
    assert (u.mean_a, u.mean_b, u.uplift_pct) == (2.0, 5.0, 150.0)


@pytest.mark.parametrize("accuracy", [50, 400])
def test_select_narrowing_paths(spark, monkeypatch, accuracy):
    """Small sketches + a tiny window force the separate collect pass and the recursion."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 1.5), rng.uniform(-3, 3, 1000)])
    df = _frame(spark, x).repartition(5)
    monkeypatch.setattr(Q, "WINDOW_LIMIT", 40)
    probs = [0.01, 0.33, 0.5, 0.77, 0.999]
    got = Q.quantiles(df, ["x"], probs, "select", accuracy=accuracy)["x"]
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]), rtol=0, atol=1e-12)


@pytest.mark.parametrize("limit,accuracy", [(100_000, 10_000), (30, 100)])
def test_grouped_quantiles_match_numpy(spark, monkeypatch, limit, accuracy):
    rng = np.random.default_rng(21)
    hot = np.r_[rng.normal(size=3000), np.full(1500, 2.0)]          # a hot group with a heavy tie
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["b"] * 400 + ["c"],
                        "x": np.r_[hot, rng.exponential(size=400), [7.0]]})
    monkeypatch.setattr(Q, "WINDOW_LIMIT", limit)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = {r.g: r for r in Q.grouped_quantiles(spark.createDataFrame(pdf).repartition(4), ["g"], "x", probs,
                                               accuracy=accuracy).collect()}
    for g, sub in pdf.groupby("g"):
        assert out[g].n == len(sub)
        assert np.allclose(out[g].q, np.percentile(sub.x, [p * 100 for p in probs]), rtol=0, atol=1e-12)
