"""Special functions against published values and identities."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.functions import distributions as D


def test_norm_ppf_numpy_and_column(spark):
    p = np.array([0.001, 0.01, 0.025, 0.05, 0.3, 0.5, 0.8, 0.975, 0.999])
    known = np.array([-3.090232306, -2.326347874, -1.959963985, -1.644853627, -0.524400513, 0.0,
                      0.841621234, 1.959963985, 3.090232306])
    assert np.allclose(D.norm_ppf(p), known, atol=1e-9)
    df = spark.createDataFrame([(float(v),) for v in p], "p double")
    got = [r[0] for r in df.select(D.norm_ppf_col("p")).collect()]
    assert np.allclose(got, known, atol=5e-9)
    assert np.allclose(D.norm_cdf(known), p, atol=1e-12)


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (2.228138852, 10, 0.05), (1.0, 1, 0.5),
                                    (3.0, 30, 0.00538996), (0.0, 5, 1.0)])
def test_t_two_sided(t, df, p):
    assert D.t_two_sided_p(t, df) == pytest.approx(p, abs=2e-6)


def test_t_one_sided_symmetry():
    assert D.t_sf(1.5, 12) + D.t_sf(-1.5, 12) == pytest.approx(1.0, abs=1e-12)


def test_mackinnon_p_at_critical_values():
    # large-sample critical values (n -> inf) must map back to their levels
    assert D.mackinnon_p(-3.43035) == pytest.approx(0.01, abs=2e-3)
    assert D.mackinnon_p(-2.86154) == pytest.approx(0.05, abs=5e-3)
    assert D.mackinnon_p(-2.56677) == pytest.approx(0.10, abs=5e-3)
    assert D.mackinnon_p(5.0) == 1.0 and D.mackinnon_p(-30.0) == 0.0
    crit = D.mackinnon_crit(100)
    assert crit["1%"] < crit["5%"] < crit["10%"] < 0


def test_shapiro_behaviour():
    rng = np.random.default_rng(1)
    w, p = D.shapiro_wilk(rng.normal(size=400))
    assert 0.98 < w <= 1.0 and p > 0.01
    w2, p2 = D.shapiro_wilk(rng.exponential(size=400))
    assert w2 < w and p2 < 1e-6
    w3, p3 = D.shapiro_wilk([1.0, 2.0, 4.0])
    assert 0.75 <= w3 <= 1.0 and 0.0 <= p3 <= 1.0
    # location/scale invariance
    x = rng.normal(size=50)
    assert D.shapiro_wilk(x)[0] == pytest.approx(D.shapiro_wilk(3 * x + 7)[0], abs=1e-12)


def test_pvalue_columns(spark):
    df = spark.createDataFrame([(2.0, 10.0)], "t double, d double")
    out = [df.select(D.t_pvalue_col(F.col("t"), F.col("d"), a)).first()[0] for a in ("two-sided", "greater", "less")]
    assert out[0] == pytest.approx(0.07338803, abs=1e-6)
    assert out[1] == pytest.approx(out[0] / 2, abs=1e-9) and out[2] == pytest.approx(1 - out[1], abs=1e-9)
    assert math.isclose(out[1] + out[2], 1.0)


def test_t_tail_in_the_jvm_equals_the_incomplete_beta(spark):
    rows = [(t, d) for t in (0.0, 0.3, -1.7, 4.0, -25.0, 300.0) for d in (0.5, 1.0, 2.0, 7.3, 60.0, 5e3, 1e6)]
    got = spark.createDataFrame(rows, "t double, d double").select("t", "d", D.t_pvalue_col(F.col("t"), F.col("d")).alias("p")).collect()
    for r in got:
        want = D.t_two_sided_p(r.t, r.d)
        assert r.p == pytest.approx(want, rel=2e-9 if r.d < 1e5 else 1e-6, abs=1e-300)
    # many degrees of freedom: the normal tail
    p = spark.range(1).select(D.t_pvalue_col(F.lit(1.96), F.lit(1e12)), D.t_pvalue_col(F.lit(None).cast("double"), F.lit(3.0)),
                              D.t_pvalue_col(F.lit(1.0), F.lit(0.0)), D.t_pvalue_col(F.lit(1e-6), F.lit(5e3))).first()
    density = math.exp(math.lgamma(2500.5) - math.lgamma(2500)) / math.sqrt(5e3 * math.pi)
    assert p[3] == pytest.approx(1 - 2e-6 * density, abs=1e-12)
    assert p[0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-9) and p[1] is None and p[2] is None


def test_normal_distribution_function(spark):
    x = [-40.0, -9.0, -7.2, -7.0, -3.0, -0.5, 0.0, 1e-9, 0.7, 2.5, 6.9, 7.5, 50.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(D.norm_cdf_col(F.col("x"))).collect()]
    for v, p in zip(x, got):
        assert p == pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), rel=1e-7 if v < -7.07 else 1e-13)


def test_lilliefors_p_is_uniform_for_normal_samples(spark):
    r, rows = np.random.default_rng(8), []
    for n in (20, 80, 400):
        for _ in range(2000):
            x = np.sort(r.normal(size=n))
            f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in (x - x.mean()) / x.std(ddof=1)])
            rows.append((n, float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))))
    p = spark.createDataFrame(rows, "n long, d double").select("n", D.lilliefors_p_col(F.col("d"), F.col("n")).alias("p")).toPandas()
    for n, of in p.groupby("n"):
        for cut in (0.01, 0.05, 0.1, 0.3, 0.5):
            assert (of["p"] < cut).mean() == pytest.approx(cut, abs=4 * math.sqrt(cut * (1 - cut) / 2000) + 0.012)
