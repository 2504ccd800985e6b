"""Structured Streaming extension: live calendar features, windowed means with
a watermark, model scoring and a stateful run-length alert.

The dashboard only recommends real-time alerts; this module offers them on
the same operators as the batch code: ``readStream`` -> calendar features ->
``withWatermark`` + sliding ``window`` mean -> threshold / model -> sink.
Checkpoints go under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scalar import RUSH_HOURS, calendar_columns, sentinel_to_null
from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over files arriving in ``path`` (explicit schema)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def live_features(stream: DataFrame, ts: str = "ts", value: str = "value",
                  rush_hours: Sequence[int] = RUSH_HOURS) -> DataFrame:
    """Sentinel -> NULL and calendar features, row by row (stateless).

    Watermarks need an instant, so a zone-less ``ts`` becomes TIMESTAMP
    (the session time zone is UTC, so the wall-clock value is unchanged)."""
    out = stream.withColumn(value, sentinel_to_null(value)).withColumns(calendar_columns(ts, "", rush_hours))
    return out.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_means(stream: DataFrame, ts: str = "ts", value: str = "value", keys: Sequence[str] = (),
                   window: str = "1 hour", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """Sliding-window mean per key; rows later than the watermark are dropped
    and a window's state is released once the watermark passes its end."""
    win = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, watermark)
                  .groupBy(win.alias("window"), *keys)
                  .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"),
                       F.max("is_rush_hour").alias("any_rush"))
                  .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          *keys, "mean_value", "n", "any_rush"))


def threshold_alerts(windows: DataFrame, threshold: float, min_n: int = 1) -> DataFrame:
    """Alert rows: window mean strictly above the (batch-fitted) threshold."""
    return windows.filter((F.col("mean_value") > F.lit(threshold)) & (F.col("n") >= min_n)) \
                  .withColumn("alert", F.lit(1))


def score_stream(stream: DataFrame, model: PipelineModel, keep: Sequence[str] = ()) -> DataFrame:
    """Apply a fitted pipeline to a stream (stages are row-wise transforms)."""
    out = model.transform(stream)
    cols = list(keep) + [c for c in ("prediction", "probability") if c in out.columns]
    return out.select(*cols)


_RUN_STATE = "run int, last_ts timestamp"
_RUN_OUT = "key string, ts timestamp, value double, run int, alert int"


def run_length_alerts(stream: DataFrame, key: str, threshold: float, run: int = 3, ts: str = "ts",
                      value: str = "value", watermark: str = "2 hours", timeout: str = "1 day") -> DataFrame:
    """Custom stateful operator: per key, count consecutive readings above
    ``threshold`` in event-time order and alert once the run reaches ``run``.

    State per key is two values (run length, last event time).  Every reading
    comes out: those of one instant in the order of their values, and one that
    arrives after a later reading of its key counts as a run of its own, as the
    runs around it are out already.  Keys idle past the event-time timeout are
    dropped from the state store."""
    flagged = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"),
                            F.col(value).cast("double").alias("value"))

    def step(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cur, last = (state.get if state.exists else (0, None))
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "value"], kind="stable")
        rows = []
        for t, v in zip(batch["ts"], batch["value"]):
            above = v is not None and not pd.isna(v) and v > threshold
            if last is not None and t < last:
                rows.append((k[0], t, v, int(above), int(above and run <= 1)))
                continue
            cur = cur + 1 if above else 0
            last = t
            rows.append((k[0], t, v, cur, int(cur >= run)))
        if last is not None:
            state.update((cur, last))
            state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + _millis(timeout))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "ts", "value", "run", "alert"])

    return flagged.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(
        step, _RUN_OUT, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _millis(duration: str) -> int:
    n, unit = duration.split()
    per = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(n) * per[unit.rstrip("s")]


def start(df: DataFrame, name: str, sink: str = "memory", path: str | None = None,
          mode: str = "append", trigger_once: bool = False, checkpoint: str | None = None):
    """Start a query with its checkpoint in the shared checkpoint folder.

    File sinks keep a stable location per query name, so a restarted job
    resumes where it stopped; the in-memory sink cannot resume and gets a
    fresh location per start."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if checkpoint is None:
        leaf = name if sink != "memory" else f"{name}-{uuid.uuid4().hex}"
        checkpoint = os.path.join(base, "streams", leaf)
    writer = (df.writeStream.outputMode(mode).queryName(name)
                .option("checkpointLocation", checkpoint))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    if sink == "memory":
        return writer.format("memory").start()
    return writer.format(sink).option("path", path).start()


def alert_job(spark: SparkSession, source: str, schema: T.StructType | str, model: PipelineModel,
              name: str = "alerts", ts: str = "ts", value: str = "value", keys: Sequence[str] = (),
              window: str = "1 hour", watermark: str = "2 hours", high: float | None = None,
              sink: str = "memory", path: str | None = None, trigger_once: bool = False,
              max_files_per_trigger: int | None = None):
    """The whole alert stream: files arriving in ``source`` -> live features ->
    model score per reading -> windowed mean score per key (watermarked) ->
    windows whose mean predicted value is above ``high`` (or whose share of
    predicted class 1 is above one half when the model is a classifier)."""
    stream = live_features(read_stream(spark, source, schema, max_files_per_trigger=max_files_per_trigger), ts, value)
    scored = model.transform(stream)
    is_class = "probability" in scored.columns
    signal = F.col("prediction").cast("double")
    win = (scored.withWatermark(ts, watermark)
                 .groupBy(F.window(ts, window).alias("window"), *keys)
                 .agg(F.avg(signal).alias("mean_score"), F.count(F.lit(1)).alias("n"),
                      F.max("is_rush_hour").alias("any_rush")))
    if not is_class and high is None:
        raise ValueError("a regressor's alerts need `high`, the value above which a window counts")
    cut = 0.5 if is_class else high
    alerts = (win.filter(F.col("mean_score") > F.lit(cut))
                 .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                         *keys, "mean_score", "n", "any_rush"))
    return start(alerts, name, sink=sink, path=path, mode="append", trigger_once=trigger_once)
