"""Degenerate inputs give NULLs, not errors (ANSI SQL raises on x / 0)."""
from hourglass.operators import evaluate as ev
from hourglass.operators import hypothesis as H
from hourglass.operators import profile as prof
from hourglass.plans.report import findings


def test_zero_divisors(spark):
    empty = spark.createDataFrame([], "a double, flag int")
    assert prof.missing_profile(empty).collect()[0].missing_pct is None
    zeros = spark.createDataFrame([(0, 0.0), (1, 2.0)], "flag int, v double")
    assert prof.uplift(zeros, "flag", "v").first().uplift_pct is None
    one_group = spark.createDataFrame([(0, 1.0), (0, 2.0)], "flag int, v double")
    r = H.welch_test(one_group, "v", "flag").first()
    assert r.t_stat is None and r.n_b == 0
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert ev.regression_metrics(flat).first().r2 is None
    negatives = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, score double")
    assert all(row.tpr is None for row in ev.roc_curve(negatives).collect())
    assert ev.auc(negatives).first().auc is None
    const = spark.createDataFrame([(0, 0, 0, 1.0)], "is_rush_hour int, weekend int, high_pollution int, value double")
    assert findings(const).count() == 7
