"""Live series: hourly means, missing hours, forward fill and the rolling mean of a stream.

The state of a key is its open hours (sums and counts), the last value, and a ring of the latest ``window`` hours.  An hour is
closed when the watermark has passed its end; closed hours come out in order, those without a reading too, with the value carried
forward and the rolling mean over the ring.  An event-time timer closes a key's hours when it has no new reading of its own.
What comes out equals the batch operators (``resample``, forward fill, ``rolling_mean``) over the same readings, whatever the order
in which they arrived within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

_STATE = ("hours array<long>, sums array<double>, counts array<long>, next long, filled double, ring array<double>")
_OUT = "key string, hour timestamp, mean_value double, n long, filled double, rolling double"


class Series:
    """One key's state between batches.  ``next`` is the hour to come out next, in buckets from the epoch."""

    def __init__(self, window: int, state: tuple | None = None):
        self.window, self.open, self.next, self.filled, self.ring = window, {}, None, None, []
        if state is not None:
            hours, sums, counts, self.next, self.filled, ring = state
            self.open, self.ring = {h: [s, c] for h, s, c in zip(hours, sums, counts)}, list(ring)

    def saved(self) -> tuple:
        hours = sorted(self.open)
        return (hours, [float(self.open[h][0]) for h in hours], [int(self.open[h][1]) for h in hours], self.next, self.filled, self.ring)

    def add(self, hours: np.ndarray, values: np.ndarray) -> None:
        """Readings of any order; those of an hour that is out already are late and do not count."""
        for h in np.unique(hours).tolist():
            if self.next is not None and h < self.next:
                continue
            of = values[hours == h]
            of = np.sort(of[~np.isnan(of)])                   # one order of summing, however they arrived in this batch
            held = self.open.setdefault(h, [0.0, 0])
            held[0] += float(of.sum())
            held[1] += len(of)

    def close(self, before: int) -> list[tuple]:
        """Rows of the hours that end by the start of hour ``before``: (hour, mean, n, filled, rolling)."""
        rows = []
        ready = [h for h in sorted(self.open) if h < before]
        for h in ready:
            for hour in range(h if self.next is None else self.next, h + 1):
                total, n = self.open.pop(hour, (0.0, 0))
                mean = total / n if n else None
                self.filled = mean if n else self.filled
                self.ring = [*self.ring, float("nan") if self.filled is None else self.filled][-self.window:]
                full = len(self.ring) == self.window and not np.isnan(self.ring).any()
                rows.append((hour, mean, n, self.filled, float(np.mean(self.ring)) if full else None))
            self.next = h + 1
        return rows


def live_series(stream: DataFrame, key: str, ts: str = "ts", value: str = "value", window: int = 168, watermark: str = "2 hours",
                bucket: str = "1 hour") -> DataFrame:
    """``key, hour, mean_value, n, filled, rolling`` of every closed hour of every key, from its first reading to its last."""
    size = int(pd.Timedelta(bucket).value // 1_000_000)       # milliseconds
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        series = Series(window, state.get if state.exists else None)
        if not state.hasTimedOut:
            for b in batches:
                b = b[b["ts"].notna()]
                hours = b["ts"].to_numpy("datetime64[ms]").astype(np.int64) // size
                series.add(hours, b["value"].to_numpy(float))
        mark = state.getCurrentWatermarkMs()
        closed = series.close(mark // size)
        state.update(series.saved())
        if series.open:                                       # the earliest open hour closes by itself
            state.setTimeoutTimestamp(max((min(series.open) + 1) * size, mark + 1))
        if closed:
            hour, mean, n, filled, rolling = zip(*closed)
            yield pd.DataFrame({"key": k[0], "hour": pd.to_datetime(np.array(hour) * size, unit="ms"), "mean_value": np.array(mean, float), "n": n,
                                "filled": np.array(filled, float), "rolling": np.array(rolling, float)})

    nulls = lambda c: F.nanvl(F.col(c), F.lit(None)).alias(c)
    out = rows.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", "hour", nulls("mean_value"), "n", nulls("filled"), nulls("rolling"))


_RUN_STATE = "run int, times array<long>, pending array<double>"
_RUN_OUT = "key string, ts timestamp, value double, run int, alert int"


def settled_run_alerts(stream: DataFrame, key: str, threshold: float, run: int = 3, ts: str = "ts", value: str = "value",
                       watermark: str = "2 hours") -> DataFrame:
    """Run lengths above ``threshold`` that do not hang on the order of arrival.

    Readings wait in the state until the watermark has passed them, then come out in order of time (and value) with the length
    of their run: the same rows as from an ordered batch of the readings that were not too late."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        length, times, pending = state.get if state.exists else (0, [], [])
        times, pending = np.array(times, np.int64), np.array([np.nan if v is None else v for v in pending], float)
        if not state.hasTimedOut:
            for b in batches:
                b = b[b["ts"].notna()]
                times = np.concatenate([times, b["ts"].to_numpy("datetime64[us]").astype(np.int64)])
                pending = np.concatenate([pending, b["value"].to_numpy(float)])
        order = np.lexsort((pending, times))
        times, pending = times[order], pending[order]
        mark = state.getCurrentWatermarkMs()
        done = int(np.searchsorted(times, mark * 1000))
        lengths = []
        for v in pending[:done].tolist():
            length = length + 1 if v > threshold else 0          # NaN is not above
            lengths.append(length)
        state.update((length, times[done:].tolist(), pending[done:].tolist()))
        if done < len(times):
            state.setTimeoutTimestamp(max(int(times[done]) // 1000 + 1, mark + 1))
        if done:
            yield pd.DataFrame({"key": k[0], "ts": pd.to_datetime(times[:done], unit="us"), "value": pending[:done], "run": np.array(lengths, np.int32),
                                "alert": (np.array(lengths) >= run).astype(np.int32)})

    out = rows.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(step, _RUN_OUT, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("value", F.nanvl("value", F.lit(None)))
