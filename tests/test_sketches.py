"""Stored sketches: merged spans against exact answers."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.operators import sketches as sk


@pytest.fixture(scope="module")
def readings(spark):
    r = np.random.default_rng(0)
    n = 40_000
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 12 * 24 * 3600, n), unit="s"),
                        "k": np.where(r.random(n) < 0.4, "hot", r.choice(["a", "b"], n)), "x": r.normal(size=n) ** 3, "y": r.integers(0, 3000, n).astype(float)})
    pdf.loc[r.random(n) < 0.1, "x"] = np.nan
    pdf.loc[pdf["ts"] >= "2024-01-11", "y"] = np.nan                       # two days without y
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    return pdf, df


def _check(row, x):
    x = x.dropna()
    assert row.n == len(x) and row["min"] == x.min() and row["max"] == x.max()
    assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std())
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        low, high = (x < row[name]).mean(), (x <= row[name]).mean()
        assert low - sk.rank_error() <= p <= high + sk.rank_error()
    assert row.distinct == pytest.approx(x.nunique(), rel=4 * sk.distinct_error())


def test_any_span_is_within_the_stated_error(readings):
    pdf, df = readings
    daily = sk.daily_sketches(df.repartition(7), "ts", ["x", "y"]).cache()
    assert daily.count() == 24
    for start, end in ((None, None), ("2024-01-03", "2024-01-05"), ("2024-01-12", "2024-01-12")):
        part = pdf[(pdf["ts"] >= (start or "2000")) & (pdf["ts"] < pd.Timestamp(end or "2100") + pd.Timedelta("1 day"))]
        got = {r["column"]: r for r in sk.span_profile(daily, start, end).collect()}
        _check(got["x"], part["x"])
        if part["y"].notna().any():
            _check(got["y"], part["y"])
        else:
            assert (got["y"].n, got["y"].q50, got["y"].distinct, got["y"].missing_pct) == (0, None, 0, 100.0)


def test_late_readings_update_known_days(readings):
    pdf, df = readings
    late = F.pmod(F.xxhash64("ts", "x"), F.lit(5)) == 0
    first, second = (sk.daily_sketches(df.where(c), "ts", ["x"], ["k"]) for c in (~late, late))
    table = sk.updated(first, second, ["k"])
    assert table.count() == table.select("day", "k").distinct().count() == 36
    for r in sk.span_profile(table, keys=["k"]).collect():
        _check(r, pdf[pdf["k"] == r.k]["x"])
