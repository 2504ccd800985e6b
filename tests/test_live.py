"""Live hourly series equal the batch operators on closed hours, with late, tied and missing readings."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.operators import clean, timeseries as ts
from hourglass.streaming import alerts as A
from hourglass.streaming.live import Series, live_series, settled_run_alerts

SCHEMA = "k string, ts timestamp, value double"


def _readings(n=900, seed=0):
    """Two keys over ten days: long gaps, several readings an hour, ties, NULL and NaN values, arrival out of order within 3 hours."""
    r = np.random.default_rng(seed)
    start = pd.Timestamp("2024-03-01 00:20:00")
    minutes = np.sort(r.integers(0, 10 * 24 * 60, n))
    minutes = minutes[(minutes < 3000) | (minutes > 4500)]                      # a day and more without a reading
    rows = pd.DataFrame({"k": r.choice(["a", "b"], len(minutes)), "ts": start + pd.to_timedelta(minutes, unit="min"), "value": np.round(r.normal(size=len(minutes)), 2)})
    rows.loc[::17, "value"] = np.nan
    rows = pd.concat([rows, rows.iloc[::13]])                                   # ties
    arrival = rows["ts"] + pd.to_timedelta(r.integers(0, 180, len(rows)), unit="min")
    return rows.iloc[np.argsort(arrival.to_numpy(), kind="stable")].reset_index(drop=True)


def _written(spark, rows, path, files):
    for part in np.array_split(np.arange(len(rows)), files):
        p = rows.iloc[part]
        spark.createDataFrame([(k, t.to_pydatetime(), None if np.isnan(v) else float(v)) for k, t, v in p.itertuples(index=False)], SCHEMA) \
            .coalesce(1).write.mode("append").parquet(path)


def _batch(spark, rows, window):
    df = spark.createDataFrame([(k, t.to_pydatetime(), None if np.isnan(v) else float(v)) for k, t, v in rows.itertuples(index=False)], SCHEMA)
    hourly = ts.resample(df, "ts", ["value"], "1 hour", keys=["k"])
    time = [c for c in hourly.columns if c not in ("k", "value")][0]
    filled = clean.forward_fill(hourly.withColumn("filled", F.col("value")), ["filled"], time, keys=["k"])
    return ts.rolling_mean(filled, "filled", time, window, keys=["k"], out="rolling").withColumnRenamed(time, "hour").toPandas()


@pytest.mark.parametrize("files, window", [(6, 12), (1, 168)])
def test_live_equals_batch_on_closed_hours(spark, tmp_path, files, window):
    rows, path = _readings(), str(tmp_path / "in")
    _written(spark, rows, path, files)
    stream = A.read_stream(spark, path, SCHEMA, max_files_per_trigger=1)
    name = f"live_{files}_{window}"
    A.start(live_series(stream, "k", window=window, watermark="3 hours"), name, trigger_once=True).awaitTermination(180)
    got = spark.table(name).toPandas().sort_values(["key", "hour"]).reset_index(drop=True)
    mark = rows["ts"].max() - pd.Timedelta("3 hours")
    want = _batch(spark, rows, window)
    want["hour"] = pd.to_datetime(want["hour"])
    want = want[want["hour"] + pd.Timedelta("1 hour") <= mark].sort_values(["k", "hour"]).reset_index(drop=True)
    last = got.groupby("key")["hour"].max()                                     # a key's closed hours end with its last closed reading
    want = want[want["hour"] <= want["k"].map(last)].reset_index(drop=True)
    assert len(got) == len(want) > 300 and (got["key"] == want["k"]).all() and (got["hour"] == want["hour"]).all()
    for a, b in (("mean_value", "value"), ("filled", "filled"), ("rolling", "rolling")):
        assert np.allclose(got[a].astype(float), want[b].astype(float), equal_nan=True)
    assert got["mean_value"].isna().sum() > 20 and got["rolling"].notna().any()


def test_a_late_reading_of_a_closed_hour_changes_nothing():
    s = Series(2)
    s.add(np.array([5, 5, 7]), np.array([1.0, 3.0, 5.0]))
    assert s.close(6) == [(5, 2.0, 2, 2.0, None)]
    s = Series(2, s.saved())                                                    # through the state store
    s.add(np.array([5, 7, 7]), np.array([100.0, 7.0, np.nan]))
    assert s.close(9) == [(6, None, 0, 2.0, 2.0), (7, 6.0, 2, 6.0, 4.0)]
    assert s.close(20) == [] and s.next == 8


def test_values_before_the_first_reading_stay_empty():
    s = Series(2)
    s.add(np.array([1, 2, 3]), np.array([np.nan, 4.0, 6.0]))
    assert s.close(4) == [(1, None, 0, None, None), (2, 4.0, 1, 4.0, None), (3, 6.0, 1, 6.0, 5.0)]


def test_runs_do_not_hang_on_arrival(spark, tmp_path):
    rows, got = _readings(400, 3), []
    for name, part in (("arrived", rows), ("sorted", rows.sort_values(["ts", "value"]).reset_index(drop=True))):
        path = str(tmp_path / name)
        _written(spark, part, path, 5)
        stream = settled_run_alerts(A.read_stream(spark, path, SCHEMA, max_files_per_trigger=1), "k", threshold=0.2, run=2, watermark="3 hours")
        A.start(stream, f"runs_{name}", trigger_once=True).awaitTermination(180)
        got.append(sorted((r.key, r.ts, str(r.value), r.run, r.alert) for r in spark.table(f"runs_{name}").collect()))
    mark, want = rows["ts"].max() - pd.Timedelta("3 hours"), []
    for k, g in rows[rows["ts"] < mark].sort_values(["ts", "value"]).groupby("k"):
        length = 0
        for t, v in zip(g["ts"], g["value"]):
            length = length + 1 if v > 0.2 else 0
            want.append((k, t.to_pydatetime(), "None" if np.isnan(v) else str(v), length, int(length >= 2)))
    assert got[0] == got[1] == sorted(want) and len(want) > 200
