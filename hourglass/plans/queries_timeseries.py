"""Time-series queries (T family, M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as tsop
from ..sources.readers import read_table
from .catalog import register
from .sweep import gram_sql, swept
from .fixtures import series_events

_HOURLY_SQL = """
WITH g AS (SELECT ts, event_type, value FROM events),
a AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM g GROUP BY 1, 2),
s AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
sp AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s),
h AS (SELECT sp.event_type, sp.ts, a.value FROM sp LEFT JOIN a USING (event_type, ts))"""

_FFILL_SQL = _HOURLY_SQL + """,
f AS (SELECT event_type, ts, last_value(value IGNORE NULLS) OVER (
        PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
      FROM h)"""


def _hourly(spark, sf_dir):
    return tsop.resample(series_events(spark, sf_dir), "ts", ["value"], "1 hour", keys=["event_type"])


@register("hourly_resample", _HOURLY_SQL + "\nSELECT * FROM h", floats=["value"], times=["ts"])
def hourly_resample(spark, sf_dir):
    """Hourly mean per series with every hour present (gaps -> NULL)."""
    return _hourly(spark, sf_dir)


@register("ffill_hourly", _FFILL_SQL + "\nSELECT * FROM f", floats=["value"], times=["ts"])
def ffill_hourly(spark, sf_dir):
    """M5: forward fill of the gap-filled hourly series, windowed per (series,
    week) with each week seeded from the weeks before it."""
    return tsop.forward_fill_chunked(_hourly(spark, sf_dir), ["value"], "ts", ["event_type"], chunk="7 days")


@register("rolling_7d", _FFILL_SQL + """
SELECT event_type, ts, value,
       CASE WHEN count(value) OVER w >= 168 THEN avg(value) OVER w END AS value_rolling
FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
          floats=["value", "value_rolling"], times=["ts"])
def rolling_7d(spark, sf_dir):
    """T4: 168-hour trailing mean after resample + forward fill; warm-up rows NULL."""
    filled = tsop.forward_fill_chunked(_hourly(spark, sf_dir), ["value"], "ts", ["event_type"], chunk="7 days")
    # windows per (series, 30-day chunk); each chunk also gets the 167 hours before it
    return tsop.rolling_mean(filled, "value", "ts", 168, ["event_type"], out="value_rolling",
                             freq="1 hour", chunk="30 days")


@register("next_hour_label", _HOURLY_SQL + """
SELECT event_type, ts, value, lead(value) OVER (PARTITION BY event_type ORDER BY ts) AS value_next FROM h""",
          floats=["value", "value_next"], times=["ts"])
def next_hour_label(spark, sf_dir):
    """Next-hour label on the gap-filled spine (forecasting target), by a
    one-hour-shifted self-join rather than a window."""
    return tsop.lead_target(_hourly(spark, sf_dir), "value", "ts", ["event_type"], freq="1 hour")


_DAILY_SQL = """
WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS o_totalprice
           FROM orders GROUP BY 1)"""


def _daily_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), "o_totalprice")
    return tsop.resample(o, "day", ["o_totalprice"], "1 day", fill_gaps=False, drop_empty=True)


@register("daily_resample", _DAILY_SQL + "\nSELECT * FROM d", floats=["o_totalprice"], times=["day"])
def daily_resample(spark, sf_dir):
    """Daily mean, empty days dropped."""
    return _daily_orders(spark, sf_dir)


def _decompose_sql(src: str, keys: tuple[str, ...] = (), period: int = 7) -> str:
    """SQL twin of ``seasonal_decompose`` (odd period) over ``src``(keys, day, y)."""
    h = period // 2
    pk = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    kc = (", ".join(keys) + ", ") if keys else ""
    pk_pos = "PARTITION BY " + ", ".join([*keys, "pos"])
    return f"""
r AS (SELECT {kc}day, y AS observed, row_number() OVER ({pk} ORDER BY day) - 1 AS rn,
             count(*) OVER ({pk}) AS n FROM {src}),
r2 AS (SELECT * FROM r WHERE n >= {max(14, 2 * period)}),
t AS (SELECT *, CASE WHEN rn >= {h} AND rn < n - {h} THEN
             sum(observed) OVER ({pk} ORDER BY rn ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) / {period}.0
             END AS trend0,
             {h} AS front, n - 1 - {h} AS back FROM r2),
t2 AS (SELECT *, least(front + {period}, back) - 1 AS front_last,
              greatest(front, back - {period}) AS back_first FROM t),
fit AS (SELECT *,
   regr_slope(CASE WHEN rn BETWEEN front AND front_last THEN trend0 END,
              CASE WHEN rn BETWEEN front AND front_last THEN CAST(rn AS DOUBLE) END) OVER ({pk}) AS kf,
   regr_intercept(CASE WHEN rn BETWEEN front AND front_last THEN trend0 END,
              CASE WHEN rn BETWEEN front AND front_last THEN CAST(rn AS DOUBLE) END) OVER ({pk}) AS cf,
   regr_slope(CASE WHEN rn BETWEEN back_first AND back - 1 THEN trend0 END,
              CASE WHEN rn BETWEEN back_first AND back - 1 THEN CAST(rn AS DOUBLE) END) OVER ({pk}) AS kb,
   regr_intercept(CASE WHEN rn BETWEEN back_first AND back - 1 THEN trend0 END,
              CASE WHEN rn BETWEEN back_first AND back - 1 THEN CAST(rn AS DOUBLE) END) OVER ({pk}) AS cb
   FROM t2),
tr AS (SELECT *, CASE WHEN rn < front THEN kf * rn + cf WHEN rn > back THEN kb * rn + cb
                      ELSE trend0 END AS trend, rn % {period} AS pos FROM fit),
de AS (SELECT *, observed - trend AS detrended FROM tr),
se AS (SELECT *, avg(detrended) OVER ({pk_pos}) AS s0, count(detrended) OVER ({pk_pos}) AS npos FROM de),
se2 AS (SELECT *, s0 - sum(s0 / npos) OVER ({pk}) / {period}.0 AS seasonal FROM se),
dec AS (SELECT {kc}day, observed, trend, seasonal, detrended - seasonal AS resid FROM se2)"""


_DEC_ORDERS_SQL = _DAILY_SQL + ",\nsrc AS (SELECT day, o_totalprice AS y FROM d)," + _decompose_sql("src")
_DEC_COLS = ["observed", "trend", "seasonal", "resid"]


@register("decompose_orders", _DEC_ORDERS_SQL + "\nSELECT * FROM dec", floats=_DEC_COLS, times=["day"])
def decompose_orders(spark, sf_dir):
    """T5: additive weekly decomposition of the daily order-value series."""
    return tsop.seasonal_decompose(_daily_orders(spark, sf_dir), "o_totalprice", "day", 7)


@register("decompose_stats", _DEC_ORDERS_SQL + """
SELECT min(trend) AS trend_min, max(trend) AS trend_max, max(seasonal) - min(seasonal) AS seasonal_amplitude,
       stddev_samp(resid) AS resid_std FROM dec""",
          floats=["trend_min", "trend_max", "seasonal_amplitude", "resid_std"])
def decompose_stats(spark, sf_dir):
    """Trend range, seasonal amplitude, residual std."""
    dec = tsop.seasonal_decompose(_daily_orders(spark, sf_dir), "o_totalprice", "day", 7)
    return tsop.decomposition_stats(dec)


_DEC_EVENTS_SQL = """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS y FROM events GROUP BY 1, 2),""" \
    + _decompose_sql("d", ("event_type",))


@register("decompose_by_type", _DEC_EVENTS_SQL + "\nSELECT * FROM dec", floats=_DEC_COLS, times=["day"])
def decompose_by_type(spark, sf_dir):
    """T5 keyed: one decomposition per series, windows partitioned by the key."""
    ev = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("day"), "value")
    daily = tsop.resample(ev, "day", ["value"], "1 day", keys=["event_type"], fill_gaps=False,
                          drop_empty=True)
    return tsop.seasonal_decompose(daily, "value", "day", 7, keys=["event_type"])


@register("adf_hourly")
def adf_hourly(spark, sf_dir):
    """ADF (AIC lag choice) per series on the hourly means, NULL hours dropped."""
    return tsop.adf_test(_hourly(spark, sf_dir), "value", "ts", keys=["event_type"])


_ADF_LAG = 3
_ADF_COLS = ["one", "level", *[f"d{i}" for i in range(1, _ADF_LAG + 1)], "dy"]
_ADF_SQL = _DAILY_SQL + f""",
s AS (SELECT row_number() OVER (ORDER BY day) AS rn, o_totalprice AS y FROM d WHERE o_totalprice IS NOT NULL),
y AS (SELECT rn, y - lag(y) OVER o AS dy, lag(y) OVER o - avg(y) OVER () AS level FROM s WINDOW o AS (ORDER BY rn)),
x AS (SELECT 1.0::DOUBLE AS one, level, dy, {', '.join(f'lag(dy, {i}) OVER (ORDER BY rn) AS d{i}' for i in range(1, _ADF_LAG + 1))} FROM y),
k AS (SELECT * FROM x WHERE d{_ADF_LAG} IS NOT NULL),
g AS ({gram_sql(_ADF_COLS, 'k')}),
{swept('g', len(_ADF_COLS) - 1)},
r AS (SELECT max(v) FILTER (i = 1 AND j = {len(_ADF_COLS) - 1}) AS beta, max(v) FILTER (i = j AND i = {len(_ADF_COLS) - 1}) AS ssr,
             -max(v) FILTER (i = 1 AND j = 1) AS inv, (SELECT count(*) FROM k) AS n FROM w{len(_ADF_COLS) - 1})
SELECT beta / sqrt(ssr / (n - {len(_ADF_COLS) - 1}) * inv) AS adf_stat, {_ADF_LAG} AS used_lag, n AS nobs FROM r"""


@register("adf_fixed_lag", _ADF_SQL, floats=["adf_stat"], ints=["used_lag", "nobs"])
def adf_fixed_lag(spark, sf_dir):
    """T7 at a fixed lag, against normal equations."""
    test = tsop.adf_test(_daily_orders(spark, sf_dir), "o_totalprice", "day", maxlag=_ADF_LAG, autolag=None)
    return test.select("adf_stat", "used_lag", "nobs")


@register("adf_daily_orders")
def adf_daily_orders(spark, sf_dir):
    """T7 on one long series: the daily order-value means."""
    return tsop.adf_test(_daily_orders(spark, sf_dir), "o_totalprice", "day")
