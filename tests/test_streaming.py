"""Streaming extension: windowed means and alerts equal the batch computation."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourglass.streaming import alerts as A


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    """The small events table written as several files, to arrive as a stream."""
    d = str(tmp_path_factory.mktemp("events_stream"))
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 4
    for i in range(4):       # files arrive in time order, one append each
        a, b = lo + step * i, (lo + step * (i + 1) if i < 3 else hi)
        part = ev.filter((F.col("ts") >= a) & ((F.col("ts") < b) if i < 3 else (F.col("ts") <= b)))
        part.coalesce(1).write.mode("append").parquet(d)
    return d, ev.schema


@pytest.mark.parametrize("window,slide", [("1 hour", None), ("2 hours", "1 hour")])
def test_windowed_means_match_batch(spark, stream_dir, window, slide):
    path, schema = stream_dir
    stream = A.live_features(A.read_stream(spark, path, schema, max_files_per_trigger=1))
    win = A.windowed_means(stream, keys=["event_type"], window=window, slide=slide, watermark="0 seconds")
    name = "win_test_" + window.replace(" ", "")
    q = A.start(win, name, mode="append", trigger_once=True)
    q.awaitTermination(120)
    got = spark.table(name).toPandas()
    batch = A.windowed_means(A.live_features(spark.read.parquet(path)), keys=["event_type"],
                             window=window, slide=slide).toPandas()
    # append mode only emits windows the watermark has closed
    closed = batch[batch.window_end <= got.window_end.max()]
    key = ["window_start", "event_type"]
    m = got.merge(closed, on=key, suffixes=("", "_b"))
    assert len(m) == len(got) == len(closed) > 0
    assert (m.n == m.n_b).all() and ((m.mean_value - m.mean_value_b).abs() < 1e-9).all()


def test_threshold_and_run_length_alerts(spark, stream_dir):
    path, schema = stream_dir
    stream = A.live_features(A.read_stream(spark, path, schema, max_files_per_trigger=2))
    alerts = A.run_length_alerts(stream, "event_type", threshold=40.0, run=3)
    q = A.start(alerts, "run_test", mode="append", trigger_once=True)
    q.awaitTermination(180)
    got = spark.table("run_test").toPandas()
    # batch reference: the same run lengths from an ordered scan per key
    ev = spark.read.parquet(path).toPandas().sort_values(["event_type", "ts", "event_id"])
    expect = []
    for k, g in ev.groupby("event_type"):
        cur = 0
        for v in g["value"]:
            cur = cur + 1 if v > 40.0 else 0
            expect.append(cur)
    assert len(got) == len(ev)
    assert sorted(got.run.tolist()) == sorted(expect)
    assert ((got.run >= 3) == (got.alert == 1)).all()
    th = A.threshold_alerts(A.windowed_means(A.live_features(spark.read.parquet(path)), keys=["event_type"]),
                            40.0)
    assert th.filter(F.col("mean_value") <= 40.0).count() == 0


def test_score_stream_with_saved_model(spark, stream_dir, tmp_path):
    from pyspark.ml import PipelineModel
    from hourglass.operators import ml
    path, schema = stream_dir
    batch = A.live_features(spark.read.parquet(path)).filter(F.col("value").isNotNull()) \
        .withColumn("label", F.col("value"))
    feats = ["hour", "weekday", "is_rush_hour"]
    model = ml.fit_one("lr", ml.feature_stages(batch, feats) + [ml.LinearRegression(regParam=0.0)],
                       batch, batch, "regression").model
    ml.save_model(model, str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    stream = A.live_features(A.read_stream(spark, path, schema)).filter(F.col("value").isNotNull())
    q = A.start(A.score_stream(stream, loaded, keep=["event_id"]), "score_test", trigger_once=True)
    q.awaitTermination(120)
    got = spark.table("score_test").toPandas().sort_values("event_id")
    want = loaded.transform(batch).select("event_id", "prediction").toPandas().sort_values("event_id")
    assert len(got) == len(want)
    assert np.allclose(got.prediction.to_numpy(), want.prediction.to_numpy())


def test_alert_job_end_to_end(spark, stream_dir, tmp_path):
    from hourglass.operators import ml
    path, schema = stream_dir
    batch = A.live_features(spark.read.parquet(path)).filter(F.col("value").isNotNull()) \
        .withColumn("label", (F.col("value") > 40).cast("double"))
    feats = ["hour", "weekday", "is_rush_hour"]
    model = ml.fit_one("lg", ml.feature_stages(batch, feats) + [ml.LogisticRegression()],
                       batch, batch, "classification").model
    q = A.alert_job(spark, path, schema, model, name="alert_job_test", keys=["event_type"],
                    watermark="0 seconds", trigger_once=True)
    q.awaitTermination(180)
    got = spark.table("alert_job_test").toPandas()
    assert set(got.columns) == {"window_start", "window_end", "event_type", "mean_score", "n", "any_rush"}
    assert (got.mean_score > 0.5).all()
    # the same windows from a batch computation over the closed windows
    scored = model.transform(A.live_features(spark.read.parquet(path)))
    win = scored.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.avg(F.col("prediction").cast("double")).alias("m")).filter("m > 0.5")
    closed = win.filter(F.col("w.end") <= F.lit(got.window_end.max()) if len(got) else F.lit(False)).count()
    assert closed == len(got)
