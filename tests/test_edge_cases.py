"""NULL keys, tied readings, zone changes, collinear columns, short series, and plans that share no exchange."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.operators import evaluate as E
from hourglass.operators import hypothesis as H
from hourglass.operators import profile as P
from hourglass.operators import relate as R
from hourglass.operators import timeseries as T
from hourglass.session import ensure_checkpoint_dir

T0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def keyed(spark):
    """30 hourly readings under key a and the same under a NULL key, hour 7 without a value."""
    rows = [(k, T0 + dt.timedelta(hours=i), None if i == 7 else float(i)) for k in ("a", None) for i in range(30)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double").cache()


def _same_for_null(df, order):
    rows = df.orderBy(*order).collect()
    a, none = ([tuple(v for c, v in r.asDict().items() if c != "k") for r in rows if (r.k is None) == null] for null in (False, True))
    assert a == none and a
    return a


def test_null_key_histogram_and_boxplot(keyed):
    bins = _same_for_null(P.histogram(keyed, "y", bins=5, keys=["k"]), ["bin"])
    assert sum(b[3] for b in bins) == 29
    assert _same_for_null(P.boxplot_stats(keyed, "y", keys=["k"]), ["median"])[0][0] == 29


def test_null_key_series(keyed):
    hourly = T.resample(keyed, "ts", ["y"], "1 hour", ["k"])
    assert len(_same_for_null(hourly, ["ts"])) == 30
    filled = _same_for_null(T.forward_fill_chunked(hourly, ["y"], "ts", ["k"], chunk="1 day"), ["ts"])
    assert filled[7][1] == 6.0
    assert _same_for_null(T.lead_target(hourly, "y", "ts", ["k"], freq="1 hour"), ["ts"])[5][2] == 6.0
    assert len(_same_for_null(T.seasonal_decompose(keyed, "y", "ts", 7, ["k"], chunk="1 day"), ["ts"])) == 29


def test_decomposition_needs_two_periods(spark):
    rows = [(T0 + dt.timedelta(days=i), float(i)) for i in range(15)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    assert T.seasonal_decompose(df, "y", "ts", 15).count() == 0
    assert T.seasonal_decompose(df, "y", "ts", 7).count() == 15


def test_back_edge_by_hand(spark):
    """20 points, period 4: the back line goes through the four trend values before the last defined one (position 17)."""
    x = [float((i * i) % 11 + i) for i in range(20)]
    df = spark.createDataFrame([(T0 + dt.timedelta(days=i), v) for i, v in enumerate(x)], "ts timestamp_ntz, y double")
    got = [r.trend for r in T.seasonal_decompose(df, "y", "ts", 4).orderBy("ts").collect()]
    trend = [(x[i - 2] / 2 + x[i - 1] + x[i] + x[i + 1] + x[i + 2] / 2) / 4 for i in range(2, 18)]     # positions 2..17
    xs, ys = [13, 14, 15, 16], trend[11:15]
    slope = sum((a - 14.5) * b for a, b in zip(xs, ys)) / 5.0
    line = [sum(ys) / 4 + slope * (a - 14.5) for a in (18, 19)]
    assert np.allclose(got[18:], line) and np.allclose(got[2:18], trend)


def test_rolling_mean_in_any_session_zone(spark):
    rows = [(dt.datetime(2024, 3, 1) + dt.timedelta(hours=i), float(i)) for i in range(24 * 40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = T.rolling_mean(df, "y", "ts", 168, freq="1 hour", chunk="8 days").orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.y_rolling for r in out[:167]] == [None] * 167
    assert np.allclose([r.y_rolling for r in out[167:]], pd.Series([r[1] for r in rows]).rolling(168).mean()[167:])


@pytest.mark.parametrize("centered", [False, True])
def test_vif_of_bad_columns(spark, centered):
    r = np.random.default_rng(1)
    a, c = r.normal(size=200), r.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": 2 * a, "c": c, "flat": np.full(200, 3.0 if centered else 0.0)}))
    got = {x.feature: x for x in R.vif(df, ["a", "b", "c", "flat"], centered).collect()}
    assert math.isinf(got["a"].vif) and math.isinf(got["b"].vif) and got["a"].risk == got["b"].risk and "High" in got["a"].risk
    assert got["flat"].vif is None and got["flat"].risk is None and 1 <= got["c"].vif < 1.2


def test_adf_of_short_and_constant_series(spark):
    r = np.random.default_rng(2)
    rows = [("long", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(r.normal(size=120))]
    rows += [("short", T0 + dt.timedelta(hours=i), float(i)) for i in range(3)] + [("one", T0, 1.0)]
    rows += [("flat", T0 + dt.timedelta(hours=i), 5.0) for i in range(60)]
    got = {x.k: x for x in T.adf_test(spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double"), "y", "ts", ["k"]).collect()}
    assert got["long"].stationary == 1 and got["long"].adf_stat < -5
    assert all(got[k].adf_stat is None and got[k].stationary is None for k in ("short", "one", "flat"))


def test_ranks_without_exchange_reuse(spark):
    """400,000 rows: range bounds are sampled, so two runs of one range partitioning differ."""
    n = 400_000
    df = spark.range(n).select((F.xxhash64("id") % 1_000_003).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        ranks = H.qq_points(df, "score").agg(F.countDistinct("i").alias("d"), F.max("i").alias("m")).first()
        last = E.roc_curve(df, "label", "score").agg(F.max("tpr").alias("t"), F.max("fpr").alias("f")).first()
        area = E.auc(df, "label", "score").first()[0]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert (ranks.d, ranks.m) == (n, n) and (last.t, last.f) == (1.0, 1.0)
    p = df.toPandas()
    rank = p.score.rank()
    pos = int(p.label.sum())
    want = (rank[p.label == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert abs(area - want) < 1e-9


def test_a_cluster_without_shared_folder_is_an_error():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://head:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_tied_and_late_readings_come_out(spark, tmp_path):
    from hourglass.streaming import alerts as A

    rows = [(1, T0, "a", 50.0), (2, T0, "a", 60.0), (3, T0 + dt.timedelta(hours=1), "a", 70.0)]
    late = [(4, T0 + dt.timedelta(minutes=30), "a", 80.0)]
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    for i, part in enumerate((rows, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    stream = src.withColumn("ts", F.col("ts").cast("timestamp"))
    q = A.start(A.run_length_alerts(stream, "event_type", threshold=40.0, run=3), "ties_test", mode="append", trigger_once=True)
    q.awaitTermination(120)
    got = sorted((r.value, r.run) for r in spark.table("ties_test").collect())
    assert [v for v, _ in got] == [50.0, 60.0, 70.0, 80.0]
