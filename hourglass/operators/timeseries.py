"""Time-series operators.

Raw rows are first reduced to one row per (key, bucket) by a partial
aggregation; window functions then run per key over buckets only, so a
window partition holds one series' buckets (hours or days), never raw rows.
Per-key model fits (ADF) aggregate a Gram matrix per key in the JVM and solve
the tiny systems per key with ``applyInPandas`` on one row per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import mackinnon_crit, mackinnon_p
from ..functions.scalar import col_of, ratio
from ..session import materialise
from .joins import key_join, measured


def bucket(ts, freq: str = "1 hour") -> Column:
    """Start of the tumbling bucket of ``ts`` (keeps TIMESTAMP_NTZ)."""
    return F.window(col_of(ts), freq).start


def _key_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def resample(df: DataFrame, ts: str, cols: Sequence[str], freq: str = "1 hour",
             keys: Sequence[str] = (), how: str = "mean", fill_gaps: bool = True,
             drop_empty: bool = False) -> DataFrame:
    """Per key and bucket aggregate; with ``fill_gaps`` every bucket
    between each key's first and last one is present (empty -> NULL).

    The spine is generated per key from the aggregated frame with
    ``sequence``, so its size is the output size, and it is joined on
    (keys, bucket) to the aggregates.
    """
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    agg = (df.select(*keys, bucket(ts, freq).alias(ts), *[col_of(c) for c in cols])
             .groupBy(*keys, ts).agg(*[fn(col_of(c)).alias(c) for c in cols]))
    if drop_empty:
        agg = agg.dropna(subset=list(cols), how="all")
    if not fill_gaps:
        return agg
    span = agg.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    # in stretches of 1000 buckets: no row holds the spine of a whole series
    n, unit = freq.split()
    stretch = span.select(*keys, "_hi", F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {1000 * int(n)} {unit}"))).alias("_from"))
    last = F.least(F.col("_from") + F.expr(f"INTERVAL {999 * int(n)} {unit}"), F.col("_hi"))
    spine = stretch.select(*keys, F.explode(F.sequence("_from", last, F.expr(f"INTERVAL {freq}"))).alias(ts))
    return key_join(spine, agg, [*keys, ts], "left")


def _micros(duration: str) -> int:
    n, unit = duration.split()
    per = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
           "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
    return int(float(n) * per[unit.rstrip("s")])


def _wall_micros(ts: str) -> Column:
    """Microseconds since 1970 on the value's own clock, whatever the session time zone (no hour is lost or doubled)."""
    t = F.col(ts)
    day = F.unix_date(F.to_date(t)).cast("long")
    second = F.date_part(F.lit("SECOND"), t).cast("decimal(8,6)")
    return day * 86_400_000_000 + F.hour(t) * 3_600_000_000 + F.minute(t) * 60_000_000 + (second * 1_000_000).cast("long")


def _chunk_of(ts: str, chunk: str) -> Column:
    return F.floor(_wall_micros(ts) / F.lit(_micros(chunk))).cast("long")


def rolling_mean(df: DataFrame, col: str, ts: str, window: int = 168, keys: Sequence[str] = (),
                 out: str | None = None, min_periods: int | None = None,
                 freq: str | None = None, chunk: str = "30 days") -> DataFrame:
    """T4: trailing mean over ``window`` rows; NULL until ``min_periods``
    (default: the full window) non-NULL values are in the frame.

    With ``freq`` (the bucket width of a regular series, one row per bucket
    as ``resample`` produces) the series is split into time chunks and each
    chunk also receives the ``window - 1`` buckets before it, so window
    partitions are (key, chunk) and no series goes through one task.
    """
    min_periods = window if min_periods is None else min_periods
    x = col_of(col)
    name = out or f"{col}_rolling"
    if freq is None:
        w = _key_window(keys).orderBy(ts).rowsBetween(-(window - 1), 0)
        return df.withColumn(name, F.when(F.count(x).over(w) >= min_periods, F.avg(x).over(w)))
    overlap = (window - 1) * _micros(freq)
    size = _micros(chunk)
    if overlap >= size:
        raise ValueError("chunk must be longer than the window")
    home = _chunk_of(ts, chunk)
    t_us = _wall_micros(ts)
    copy_next = t_us >= (home + 1) * F.lit(size) - F.lit(overlap)
    chunks = F.when(copy_next, F.array(home, home + 1)).otherwise(F.array(home))
    cols = df.columns
    spread = df.select(*[col_of(c) for c in cols], home.alias("_home"), F.explode(chunks).alias("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(-(window - 1), 0)
    return (spread.withColumn(name, F.when(F.count(x).over(w) >= min_periods, F.avg(x).over(w)))
                  .filter(F.col("_chunk") == F.col("_home")).select(*[col_of(c) for c in cols], name))


def forward_fill_chunked(df: DataFrame, cols: Sequence[str], ts: str, keys: Sequence[str] = (),
                         chunk: str = "30 days") -> DataFrame:
    """M5 for long series: fill within (key, time chunk) windows, seeding each
    chunk with the last non-NULL value of the chunks before it (one summary
    row per chunk, carried forward over the small chunk table)."""
    keys = list(keys)
    data = df.withColumn("_chunk", _chunk_of(ts, chunk))
    summary = data.groupBy(*keys, "_chunk").agg(
        *[F.max_by(col_of(c), F.when(col_of(c).isNotNull(), F.col(ts))).alias(f"_last{i}")
          for i, c in enumerate(cols)])
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", *[F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_in{i}")
                                              for i in range(len(cols))])
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = key_join(data, carry, [*keys, "_chunk"])
    return filled.select(*[F.coalesce(F.last(col_of(c), ignorenulls=True).over(w), F.col(f"_in{cols.index(c)}"))
                           .alias(c) if c in cols else col_of(c) for c in df.columns])


def lead_target(df: DataFrame, col: str, ts: str, keys: Sequence[str] = (), steps: int = 1,
                out: str | None = None, freq: str | None = None) -> DataFrame:
    """Next-period label (e.g. next-hour value).

    With ``freq`` (the bucket width) the label is the value ``steps`` buckets
    later, found by an equi-join of the series with itself shifted in time:
    no window, so no series passes through one task.  Without ``freq`` it is
    the next row per key (``lead``)."""
    name = out or f"{col}_next"
    if freq is None:
        w = _key_window(keys).orderBy(ts)
        return df.withColumn(name, F.lead(col_of(col), steps).over(w))
    shifted = df.select(*keys, (F.col(ts) - F.expr(f"INTERVAL {steps * int(freq.split()[0])} "
                                                   f"{freq.split()[1]}")).alias(ts),
                        col_of(col).alias(name))
    return key_join(df, shifted, [*keys, ts], "left")


# ---------------------------------------------------------------- positions and blocks
def positions(df: DataFrame, keys: Sequence[str], ts: str, chunk: str = "30 days",
              mean_of: str | None = None) -> DataFrame:
    """0-based position ``rn`` of each row in its key's time order and the
    key's row count ``n`` (optionally the key's mean of ``mean_of`` as
    ``_mean``), without a window over a whole series: rows are numbered
    inside time chunks, and each chunk's offset comes from a running total
    over the small table of per-(key, chunk) counts."""
    keys = list(keys)
    d = df.withColumn("_pc", _chunk_of(ts, chunk))
    d = d.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_pc").orderBy(ts)) - 1)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if mean_of:
        aggs.append(F.sum(mean_of).alias("_sum"))
    chunks = d.groupBy(*keys, "_pc").agg(*aggs)
    # one row per (key, chunk): running totals over that small table
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_pc") \
        .rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    sel = [*keys, "_pc", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
           F.sum("_cnt").over(whole).alias("n")]
    if mean_of:
        sel.append(ratio(F.sum("_sum").over(whole), F.sum("_cnt").over(whole)).alias("_mean"))
    offs = chunks.select(*sel)
    return (key_join(d, offs, [*keys, "_pc"]).withColumn("rn", F.col("_off") + F.col("_local"))
             .drop("_pc", "_local", "_off"))


def blocked(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Give each row a home block ``floor(rn / block)`` and copy it into the
    neighbouring block(s) that need it, so a frame of ``before`` rows back and
    ``after`` rows ahead is complete within every row's home block.  Window
    partitions are then (key, block); keep rows with ``_blk == _home``."""
    if before >= block or after >= block:
        raise ValueError("block must be longer than the frame")
    home = F.floor(F.col("rn") / block).cast("long")
    off = F.col("rn") - home * block
    targets = F.array_compact(F.array(home, F.when(off >= block - before, home + 1),
                                      F.when(off < after, home - 1)))
    return df.withColumn("_home", home).withColumn("_blk", F.explode(targets))


def _block_size(frame: int, block: int | None) -> int:
    return block or max(4096, 2 * frame + 1)


# ---------------------------------------------------------------- decomposition
def seasonal_decompose(df: DataFrame, col: str, ts: str, period: int = 7, keys: Sequence[str] = (),
                       min_points: int = 14, chunk: str = "30 days", block: int | None = None) -> DataFrame:
    """T5: additive decomposition observed = trend + seasonal + resid.

    Positions, not dates, define the cycle (after empty buckets are dropped).
    Trend: centred moving average (2 x m filter for even periods); the
    missing ends are extrapolated by a least-squares line through the nearest
    ``period`` defined trend values.  Seasonal: mean detrended value per
    position mod period, re-centred to mean zero over the period.  Keys with
    fewer than ``min_points`` observations are left out.

    No window spans a whole series: positions come from chunk offsets, the
    moving average runs per (key, position block) with the ``period // 2``
    neighbours copied in, and the edge lines and seasonal means are per-key
    aggregates joined back.
    """
    keys = list(keys)
    y = col_of(col).cast("double")
    s = df.select(*keys, col_of(ts).alias(ts), y.alias("observed")).filter(F.col("observed").isNotNull())
    h = period // 2
    bsize = _block_size(2 * h, block)
    blk = blocked(positions(s, keys, ts, chunk), h, h, bsize)
    blk = blk.filter(F.col("n") >= max(min_points, 2 * period))
    w = Window.partitionBy(*keys, "_blk").orderBy("rn")
    total = F.sum("observed").over(w.rowsBetween(-h, h))
    if period % 2:
        ma = total / period
    else:
        ma = (total - 0.5 * (F.lag("observed", h).over(w) + F.lead("observed", h).over(w))) / period
    s = (blk.withColumn("trend0", F.when((F.col("rn") >= h) & (F.col("rn") < F.col("n") - h), ma))
            .filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home"))
    front, back = F.lit(h), F.col("n") - 1 - h
    # the lines go through ``period`` values from the first defined one on, and ``period`` values before the last
    front_last = F.least(front + period, back) - 1
    back_first = F.greatest(front, back - period)
    rn = F.col("rn").cast("double")
    in_front = (F.col("rn") >= front) & (F.col("rn") <= front_last)
    in_back = (F.col("rn") >= back_first) & (F.col("rn") < back)
    fits = {"kf": F.regr_slope(F.when(in_front, F.col("trend0")), F.when(in_front, rn)),
            "cf": F.regr_intercept(F.when(in_front, F.col("trend0")), F.when(in_front, rn)),
            "kb": F.regr_slope(F.when(in_back, F.col("trend0")), F.when(in_back, rn)),
            "cb": F.regr_intercept(F.when(in_back, F.col("trend0")), F.when(in_back, rn))}
    s = materialise(s)                                      # read for the lines and again for the rest
    s = _attach(s, s.groupBy(*keys).agg(*[agg.alias(name) for name, agg in fits.items()]), keys)
    trend = (F.when(F.col("rn") < front, F.col("kf") * rn + F.col("cf"))
             .when(F.col("rn") > back, F.col("kb") * rn + F.col("cb"))
             .otherwise(F.col("trend0")))
    s = s.withColumn("trend", trend).withColumn("detrended", F.col("observed") - F.col("trend")) \
         .withColumn("pos", F.pmod(F.col("rn"), F.lit(period)))
    # ``period`` means a key, held as one map: no join of the series on its position
    seas = s.groupBy(*keys, "pos").agg(F.avg("detrended").alias("seasonal0")).groupBy(*keys).agg(
        F.avg("seasonal0").alias("_center"), F.map_from_entries(F.collect_list(F.struct("pos", "seasonal0"))).alias("_seasonal"))
    s = _attach(s, seas, keys, literal=False).withColumn("seasonal", F.col("_seasonal")[F.col("pos")] - F.col("_center"))
    return s.select(*keys, ts, "observed", "trend", "seasonal",
                    (F.col("detrended") - F.col("seasonal")).alias("resid"))


def _attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], literal: bool = True) -> DataFrame:
    """Add per-key values: an equi-join on the keys (one row per key), or for
    an unkeyed series the single row's values as literals (or by its broadcast)."""
    if not keys and not literal:
        one = F.lit(0)
        return df.withColumn("_one", one).join(F.broadcast(per_key.withColumn("_one", one)), "_one").drop("_one")
    if keys:
        return key_join(df, measured(per_key), keys)
    row = per_key.first()
    return df.withColumns({c: F.lit(row[c]) for c in per_key.columns})


def decomposition_stats(dec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trend range, seasonal amplitude, residual std (n-1)."""
    return dec.groupBy(*keys).agg(
        F.min("trend").alias("trend_min"), F.max("trend").alias("trend_max"),
        (F.max("seasonal") - F.min("seasonal")).alias("seasonal_amplitude"),
        F.stddev_samp("resid").alias("resid_std"))


# ---------------------------------------------------------------- ADF
def _default_maxlag(n):
    """ceil(12 (n/100)^(1/4)), capped at n // 2 - 2 (constant-only regression)."""
    return F.greatest(F.least(F.ceil(F.lit(12.0) * F.pow(n / 100.0, 0.25)), F.floor(n / 2) - 2), F.lit(0)).cast("int")


def adf_test(df: DataFrame, col: str, ts: str, keys: Sequence[str] = (),
             maxlag: int | None = None, autolag: str | None = "AIC", chunk: str = "30 days",
             block: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test (constant, no trend) per key.

    Regresses dy_t on [1, y_{t-1}, dy_{t-1} .. dy_{t-p}] with positional lags
    over each key's non-NULL observations.  With ``autolag="AIC"`` every p in
    0..maxlag is fitted on the common sample t > maxlag and the smallest AIC
    wins; the chosen p is then refitted on its own full sample t > p.

    Positions and lags are computed per (key, position block), never over a
    whole series.  One aggregation per key yields the Gram matrix of the
    common sample plus the (at most maxlag) earlier rows; every candidate fit
    and the refit are then tiny solves done per key in ``applyInPandas``.
    """
    keys = list(keys)
    gkeys = keys or ["_series"]
    base = df.select(*keys, col_of(ts).alias("_t"), col_of(col).cast("double").alias("y")) \
             .filter(F.col("y").isNotNull())
    if not keys:
        base = base.withColumn("_series", F.lit(0))
    # the bucketed series is read twice (size scan, Gram pass): materialise it
    # once in the shared checkpoint folder, which also cuts the lineage
    base = materialise(base)
    # largest lag any key can use: one scalar from the largest series
    n_max = base.groupBy(*gkeys).count().agg(F.max("count")).first()[0]
    key_schema = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in gkeys)
    if n_max is None:
        return df.sparkSession.createDataFrame([], f"{key_schema}, {_ADF_SCHEMA}, stationary int") \
            .drop("_series")
    L = maxlag if maxlag is not None else min(int(math.ceil(12.0 * (n_max / 100.0) ** 0.25)), n_max // 2 - 2)
    L = max(int(L), 0)
    bsize = _block_size(L + 1, block)
    # lags up to L + 1 rows back: windows per (key, position block) with those rows copied in
    base = blocked(positions(base, gkeys, "_t", chunk, mean_of="y"), L + 1, 0, bsize)
    ow = Window.partitionBy(*gkeys, "_blk").orderBy("rn")
    base = base.withColumn("dy", F.col("y") - F.lag("y", 1).over(ow)) \
               .withColumn("ylag", F.lag("y", 1).over(ow) - F.col("_mean"))   # centred level: better conditioning
    base = base.withColumns({f"d{i}": F.lag("dy", i).over(ow) for i in range(1, L + 1)})
    base = base.filter(F.col("_blk") == F.col("_home"))
    klag = F.lit(maxlag) if maxlag is not None else _default_maxlag(F.col("n"))
    base = base.withColumn("kmax", klag)
    names = ["one", "ylag"] + [f"d{i}" for i in range(1, L + 1)] + ["dy"]
    m = len(names)
    tri = [(i, j) for i in range(m) for j in range(i, m)]
    z = F.array(F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in names[1:]]).alias("_z")
    rows = base.select(*gkeys, "rn", "kmax", "n", z)
    iu = np.triu_indices(m)

    def partial(batches):
        """Per key of a task: Gram of the common-sample rows (numpy), plus the
        few rows before the common sample (at most maxlag per key)."""
        sums: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            if len(sums) > 1000:                             # many keys: hand on what there is
                yield pd.DataFrame(list(sums.values()))
                sums = {}
            for key, g in pdf.groupby(gkeys, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                zz = np.vstack(g["_z"].to_numpy())
                common = (g["rn"] >= g["kmax"] + 1).to_numpy()
                edge = ((g["rn"] >= 1) & (g["rn"] <= g["kmax"])).to_numpy()
                zc = zz[common]
                names_ = tuple(None if pd.isna(v) else v for v in key)
                had = sums.setdefault(names_, {**dict(zip(gkeys, key)), "kmax": int(g["kmax"].iloc[0]), "n": int(g["n"].iloc[0]), "nobs": 0,
                                               "cells": np.zeros(len(tri)), "edge_rn": [], "edge_z": []})
                had["nobs"] += int(common.sum())
                had["cells"] = had["cells"] + (zc.T @ zc)[iu]
                had["edge_rn"] += g["rn"].to_numpy()[edge].tolist()
                had["edge_z"] += zz[edge].tolist()
        if sums:
            yield pd.DataFrame(list(sums.values()))

    key_schema = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in gkeys)
    part = materialise(rows.mapInPandas(partial, f"{key_schema}, kmax int, n long, nobs long, cells array<double>, "
                                     "edge_rn array<long>, edge_z array<array<double>>"))
    # the tasks' Grams are added up cell by cell (map-side first); a key then holds one Gram and at most maxlag early rows
    cells = (part.select(*gkeys, F.posexplode("cells").alias("pos", "v")).groupBy(*gkeys, "pos").agg(F.sum("v").alias("v"))
             .groupBy(*gkeys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("cells")))
    grams = part.groupBy(*gkeys).agg(
        F.first("kmax").alias("kmax"), F.first("n").alias("n"), F.sum("nobs").alias("nobs"),
        F.flatten(F.collect_list("edge_rn")).alias("edge_rn"), F.flatten(F.collect_list("edge_z")).alias("edge_z"))
    grams = key_join(grams, cells, gkeys)
    use_aic = bool(autolag)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        g = np.zeros((m, m))
        g[iu] = np.asarray(row["cells"], dtype=float)
        g = g + np.triu(g, 1).T
        nobs, kmax = int(row["nobs"]), int(row["kmax"])
        p, icbest = kmax, float("nan")
        if use_aic:
            best = None
            for q in range(0, kmax + 1):
                ssr = _ssr(g, list(range(q + 2)), m - 1)
                if ssr is None or nobs <= 0:
                    continue
                llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
                aic = -2 * llf + 2 * (q + 2)
                if best is None or aic < best[0]:
                    best = (aic, q)
            if best is not None:
                icbest, p = best
        # refit on t > p: add the edge rows p+1..kmax to the common Gram
        g2 = g.copy()
        n2 = nobs
        edges = zip(row["edge_rn"] if row["edge_rn"] is not None else [],
                    row["edge_z"] if row["edge_z"] is not None else [])
        for rn, z in edges:
            rn, z = int(rn), np.asarray(z, dtype=float)
            if rn >= p + 1:
                g2 += np.outer(z, z)
                n2 += 1
        idx = list(range(p + 2))
        stat = float("nan")
        try:
            inv = np.linalg.inv(g2[np.ix_(idx, idx)])
            xty = g2[idx, m - 1]
            beta = inv @ xty
            ssr = float(g2[m - 1, m - 1] - beta @ xty)
            dof = n2 - len(idx)
            if dof > 0:                      # else the series is too short: no statistic
                stat = float(beta[1] / math.sqrt(ssr / dof * inv[1, 1]))
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            pass                             # constant or degenerate series: no statistic
        crit = mackinnon_crit(n2) if n2 > 0 else {"1%": None, "5%": None, "10%": None}
        out = {k: [row[k]] for k in gkeys}
        out.update({"adf_stat": [stat], "p_value": [mackinnon_p(stat) if not math.isnan(stat) else float("nan")],
                    "used_lag": [p], "nobs": [n2], "crit_1pct": [crit["1%"]], "crit_5pct": [crit["5%"]],
                    "crit_10pct": [crit["10%"]], "icbest": [icbest]})
        return pd.DataFrame(out)

    res = grams.groupBy(*gkeys).applyInPandas(solve, f"{key_schema}, {_ADF_SCHEMA}")
    res = res.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("adf_stat", "p_value", "icbest")})
    res = res.withColumn("stationary", (F.col("p_value") < 0.05).cast("int"))
    return res.drop("_series") if not keys else res


_ADF_SCHEMA = ("adf_stat double, p_value double, used_lag int, nobs long, crit_1pct double, "
               "crit_5pct double, crit_10pct double, icbest double")


def _ssr(g: np.ndarray, idx: list[int], yi: int) -> float | None:
    xtx, xty = g[np.ix_(idx, idx)], g[idx, yi]
    try:
        beta = np.linalg.solve(xtx, xty)
    except np.linalg.LinAlgError:
        return None
    ssr = float(g[yi, yi] - beta @ xty)
    return ssr if ssr > 0 else None
