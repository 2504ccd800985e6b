"""Cleaning and profiling queries (P, M, A families) with their SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators.clean import nullify_sentinel
from ..sources.readers import read_table
from .catalog import register
from .fixtures import LINEITEM_NUMERIC, clean_events, sensor_events

# ----------------------------------------------------------------- shared SQL
RAW_EVENTS_SQL = """
raw AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 11 = 0 THEN -200.0 ELSE value END AS value
  FROM events),
nulled AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN isnan(value) OR value = -200 THEN NULL ELSE value END AS value
  FROM raw)"""

CLEAN_EVENTS_SQL = "WITH " + RAW_EVENTS_SQL + """,
filled AS (
  SELECT event_id, ts, user_id, event_type,
         coalesce(value, (SELECT median(value) FROM nulled)) AS value
  FROM nulled WHERE ts IS NOT NULL),
clean AS (
  SELECT event_id, ts, user_id, event_type, value,
         hour(ts) AS hour, day(ts) AS day, month(ts) AS month,
         isodow(ts) - 1 AS weekday,
         CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS weekend,
         CASE WHEN month(ts) IN (3, 4, 5) THEN 'Spring'
              WHEN month(ts) IN (6, 7, 8) THEN 'Summer'
              WHEN month(ts) IN (9, 10, 11) THEN 'Autumn'
              ELSE 'Winter' END AS season,
         CASE WHEN hour(ts) IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS is_rush_hour,
         CASE WHEN value > (SELECT median(value) FROM filled) THEN 1 ELSE 0 END AS high_pollution
  FROM filled)"""

CLEAN_INTS = ("event_id", "user_id", "hour", "day", "month", "weekday", "weekend",
              "is_rush_hour", "high_pollution")


# ----------------------------------------------------------------- cleaning
@register("clean_events", CLEAN_EVENTS_SQL + "\nSELECT * FROM clean",
          floats=["value"], ints=CLEAN_INTS, times=["ts"])
def clean_events_q(spark, sf_dir):
    """The whole cleaning chain on the sentinel-coded events."""
    return clean_events(spark, sf_dir)


@register("hourly_profile", CLEAN_EVENTS_SQL + """
SELECT hour, avg(value) AS mean_value, count(*) AS n, max(is_rush_hour) AS is_rush_hour
FROM clean GROUP BY hour""", floats=["mean_value"], ints=["hour", "n", "is_rush_hour"])
def hourly_profile(spark, sf_dir):
    """A9 + P8: mean of the cleaned value by hour of day, flagged rush hours."""
    df = clean_events(spark, sf_dir)
    return df.groupBy("hour").agg(F.avg("value").alias("mean_value"),
                                  F.count(F.lit(1)).alias("n"),
                                  F.max("is_rush_hour").alias("is_rush_hour"))


@register("hourly_mean_by_type", CLEAN_EVENTS_SQL + """
SELECT hour, event_type, avg(value) AS mean_value FROM clean GROUP BY hour, event_type""",
          floats=["mean_value"], ints=["hour"])
def hourly_mean_by_type(spark, sf_dir):
    """A9 second form: hourly means for every series at once (one pass)."""
    df = clean_events(spark, sf_dir)
    return df.groupBy("hour", "event_type").agg(F.avg("value").alias("mean_value"))


@register("weekday_mean", CLEAN_EVENTS_SQL + """
SELECT weekday, CASE weekday WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu'
       WHEN 4 THEN 'Fri' WHEN 5 THEN 'Sat' ELSE 'Sun' END AS day_name,
       avg(value) AS mean_value, count(*) AS n
FROM clean GROUP BY weekday""", floats=["mean_value"], ints=["weekday", "n"])
def weekday_mean(spark, sf_dir):
    """A10 + P9 + T8: mean by weekday (Mon=0), with day names."""
    from ..functions.scalar import day_name
    df = clean_events(spark, sf_dir)
    return (prof.group_means(df, "weekday", ["value"])
            .select("weekday", day_name("weekday").alias("day_name"),
                    F.col("mean_value").alias("mean_value"), "n"))


@register("month_mean", """
SELECT month(o_orderdate) AS month, avg(o_totalprice) AS mean_o_totalprice, count(*) AS n
FROM orders GROUP BY month(o_orderdate)""", floats=["mean_o_totalprice"], ints=["month", "n"])
def month_mean(spark, sf_dir):
    """Mean by month number (years merged, as the dashboard does)."""
    o = read_table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), "o_totalprice")
    return prof.group_means(o, "month", ["o_totalprice"])


@register("year_month_mean", """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month,
       avg(o_totalprice) AS mean_o_totalprice, count(*) AS n
FROM orders GROUP BY 1, 2""", floats=["mean_o_totalprice"], ints=["year", "month", "n"])
def year_month_mean(spark, sf_dir):
    """A11 variant: mean by calendar month (years kept apart)."""
    o = read_table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return prof.group_means(o, ["year", "month"], ["o_totalprice"])


@register("season_mean", """
SELECT CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
            WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer'
            WHEN month(o_orderdate) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS season,
       avg(o_totalprice) AS mean_o_totalprice, count(*) AS n
FROM orders GROUP BY 1""", floats=["mean_o_totalprice"], ints=["n"])
def season_mean(spark, sf_dir):
    """A12 + P7: mean by season."""
    from ..functions.scalar import season
    o = read_table(spark, sf_dir, "orders").select(season(F.month("o_orderdate")).alias("season"),
                                                   "o_totalprice")
    return prof.group_means(o, "season", ["o_totalprice"])


# ----------------------------------------------------------------- missingness
_MISSING_COLS = ("event_id", "ts", "user_id", "event_type", "value")
_MISSING_SQL = "WITH " + RAW_EVENTS_SQL + ",\ncounts AS (\n" + "\nUNION ALL\n".join(
    f"  SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM nulled"
    for c in _MISSING_COLS) + """)
SELECT "column", missing, n AS rows, round_even(missing * 100.0 / n, 1) AS missing_pct,
       CASE WHEN missing * 100.0 / n > 50 THEN 'drop'
            WHEN missing > 0 THEN 'impute_median' ELSE 'none' END AS action,
       CASE WHEN missing * 100.0 / n > 50 THEN 1 ELSE 0 END AS over_threshold
FROM counts"""


@register("missing_profile", _MISSING_SQL, floats=["missing_pct"], ints=["missing", "rows", "over_threshold"])
def missing_profile(spark, sf_dir):
    """M2/M4 (+P1): per-column missing count, %, rule-based action, 50 % flag."""
    raw = nullify_sentinel(sensor_events(spark, sf_dir), ["value"])
    return prof.missing_profile(raw)


@register("overall_missing", "WITH " + RAW_EVENTS_SQL + """
SELECT round_even(avg(pct), 1) AS overall_missing_pct FROM (
""" + "\nUNION ALL\n".join(
    f"  SELECT count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS pct FROM nulled"
    for c in _MISSING_COLS) + "\n)", floats=["overall_missing_pct"])
def overall_missing(spark, sf_dir):
    """M3: mean of the per-column missing percentages."""
    raw = nullify_sentinel(sensor_events(spark, sf_dir), ["value"])
    return prof.overall_missing_pct(prof.missing_profile(raw))


@register("shape_kpis", CLEAN_EVENTS_SQL + """
SELECT count(*) AS rows, min(ts) AS period_start, max(ts) AS period_end,
       13 AS columns, 0 AS sensor_columns FROM clean""",
          ints=["rows", "columns", "sensor_columns"], times=["period_start", "period_end"])
def shape_kpis(spark, sf_dir):
    """A1: row/column counts and the observed period."""
    return prof.shape_kpis(clean_events(spark, sf_dir), ts="ts")


# ----------------------------------------------------------------- describe / skew
_DESCRIBE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
       quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem""" for c in LINEITEM_NUMERIC)


@register("describe_lineitem", _DESCRIBE_SQL,
          floats=["mean", "std", "min", "q25", "q50", "q75", "max"], ints=["count"])
def describe_lineitem(spark, sf_dir):
    """A3: describe() of every numeric lineitem measure in one pass."""
    return prof.describe(read_table(spark, sf_dir, "lineitem"), list(LINEITEM_NUMERIC))


@register("skewness_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count({c}) AS n, skewness({c}) AS skew, CASE WHEN abs(skewness({c})) > 1 THEN 1 ELSE 0 END AS strong FROM lineitem"
    for c in LINEITEM_NUMERIC), floats=["skew"], ints=["n", "strong"])
def skewness_lineitem(spark, sf_dir):
    """A4: bias-adjusted skewness per column."""
    return prof.skewness(read_table(spark, sf_dir, "lineitem"), list(LINEITEM_NUMERIC))


@register("median_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {p} AS prob, quantile_cont({c}, {p}) AS value FROM lineitem"
    for c in LINEITEM_NUMERIC for p in (0.1, 0.5, 0.9)),
          floats=["prob", "value"])
def median_lineitem(spark, sf_dir):
    """M1 engine: exact whole-column quantiles with bounded memory (selection)."""
    li = read_table(spark, sf_dir, "lineitem")
    return prof.quantile_table(li, list(LINEITEM_NUMERIC), [0.1, 0.5, 0.9], method="select")


# ----------------------------------------------------------------- histograms
def _hist_sql(table, col, keys=(), bins=40, density=False):
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join(f"d.{x} = s.{x}" for x in keys) or "TRUE"
    on2 = " AND ".join(f"c.{x} = r.{x}" for x in keys)
    on2 = (on2 + " AND ") if keys else ""
    b = f"CAST({bins} AS DOUBLE)"
    dens = (", CASE WHEN (hi - lo) / {b} > 0 THEN coalesce(c.count, 0) / (n * ((hi - lo) / {b})) END AS density"
            .format(b=b)) if density else ""
    rk = ", ".join(f"r.{x}" for x in keys)
    rk = (rk + ", ") if keys else ""
    return f"""
WITH d AS (SELECT {kc}CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL),
s AS (SELECT {kc}min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
             max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi,
             count(*) AS n FROM d {"GROUP BY " + k if keys else ""}),
g AS (SELECT {", ".join("d." + x for x in keys) + ", " if keys else ""}x, lo, hi,
             least(greatest(CAST(floor((x - lo) * ({b} / (hi - lo))) AS INTEGER), 0), {bins - 1}) AS g
      FROM d JOIN s ON {on}),
bn AS (SELECT {kc}CASE WHEN hi = lo THEN 0
                  WHEN x < lo + g * ((hi - lo) / {b}) THEN g - 1
                  WHEN x >= lo + (g + 1) * ((hi - lo) / {b}) AND g <> {bins - 1} THEN g + 1
                  ELSE g END AS bin FROM g),
c AS (SELECT {kc}bin, count(*) AS count FROM bn GROUP BY {kc}bin),
r AS (SELECT s.*, CAST(range AS INTEGER) AS bin FROM s, range({bins}))
SELECT {rk}r.bin, lo + r.bin * ((hi - lo) / {b}) AS bin_lo,
       CASE WHEN r.bin = {bins - 1} THEN hi ELSE lo + (r.bin + 1) * ((hi - lo) / {b}) END AS bin_hi,
       coalesce(c.count, 0) AS count{dens}
FROM r LEFT JOIN c ON {on2}c.bin = r.bin"""


@register("histogram_acctbal", _hist_sql("customer", "c_acctbal"),
          floats=["bin_lo", "bin_hi"], ints=["bin", "count"])
def histogram_acctbal(spark, sf_dir):
    """A5: 40 equal-width bins, numpy edge rules, empty bins kept."""
    return prof.histogram(read_table(spark, sf_dir, "customer"), "c_acctbal", bins=40)


@register("histogram_by_segment", _hist_sql("customer", "c_acctbal", ["c_mktsegment"], density=True),
          floats=["bin_lo", "bin_hi", "density"], ints=["bin", "count"])
def histogram_by_segment(spark, sf_dir):
    """Per-group density histograms, each group with its own edges."""
    return prof.histogram(read_table(spark, sf_dir, "customer"), "c_acctbal", bins=40,
                          keys=["c_mktsegment"], density=True)


def _box_sql(table, col, keys=()):
    kc = (", ".join(keys) + ", ") if keys else ""
    grp = ("GROUP BY " + ", ".join(keys)) if keys else ""
    on = " AND ".join(f"d.{x} = q.{x}" for x in keys) or "TRUE"
    qk = (", ".join("q." + x for x in keys) + ", ") if keys else ""
    return f"""
WITH d AS (SELECT {kc}CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL),
q AS (SELECT {kc}count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM d {grp})
SELECT {qk}q.n, q.mean, q.q1, q.median, q.q3,
       min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS fliers
FROM d JOIN q ON {on}
GROUP BY {qk}q.n, q.mean, q.q1, q.median, q.q3"""


@register("boxplot_by_segment", _box_sql("customer", "c_acctbal", ["c_mktsegment"]),
          floats=["mean", "q1", "median", "q3", "whisker_lo", "whisker_hi"], ints=["n", "fliers"])
def boxplot_by_segment(spark, sf_dir):
    """Box-plot statistics per group."""
    return prof.boxplot_stats(read_table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])


@register("boxplot_quantity", _box_sql("lineitem", "l_extendedprice"),
          floats=["mean", "q1", "median", "q3", "whisker_lo", "whisker_hi"], ints=["n", "fliers"])
def boxplot_quantity(spark, sf_dir):
    """Whole-column box plot (stats carried as literals, no join)."""
    return prof.boxplot_stats(read_table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ----------------------------------------------------------------- counts / uplift
@register("rush_counts", CLEAN_EVENTS_SQL + """
SELECT is_rush_hour, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM clean GROUP BY is_rush_hour""", floats=["share_pct"], ints=["is_rush_hour", "count"])
def rush_counts(spark, sf_dir):
    """Rush-hour row counts and shares."""
    return prof.value_counts(clean_events(spark, sf_dir), "is_rush_hour")


@register("target_balance", CLEAN_EVENTS_SQL + """
SELECT high_pollution, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM clean GROUP BY high_pollution""", floats=["share_pct"], ints=["high_pollution", "count"])
def target_balance(spark, sf_dir):
    """Balance of the median-threshold target (true balance reported)."""
    return prof.value_counts(clean_events(spark, sf_dir), "high_pollution")


@register("rush_uplift", CLEAN_EVENTS_SQL + """
SELECT event_type, avg(value) FILTER (WHERE is_rush_hour = 0) AS mean_a,
       avg(value) FILTER (WHERE is_rush_hour = 1) AS mean_b,
       count(*) FILTER (WHERE is_rush_hour = 0) AS n_a,
       count(*) FILTER (WHERE is_rush_hour = 1) AS n_b,
       (avg(value) FILTER (WHERE is_rush_hour = 1) - avg(value) FILTER (WHERE is_rush_hour = 0))
         / avg(value) FILTER (WHERE is_rush_hour = 0) * 100.0 AS uplift_pct
FROM clean GROUP BY event_type""", floats=["mean_a", "mean_b", "uplift_pct"], ints=["n_a", "n_b"])
def rush_uplift(spark, sf_dir):
    """Rush vs off-peak mean and uplift % per series, one pass."""
    return prof.uplift(clean_events(spark, sf_dir), "is_rush_hour", "value", ["event_type"])


@register("weekend_uplift", CLEAN_EVENTS_SQL + """
SELECT avg(value) FILTER (WHERE weekend = 0) AS mean_a,
       avg(value) FILTER (WHERE weekend = 1) AS mean_b,
       count(*) FILTER (WHERE weekend = 0) AS n_a,
       count(*) FILTER (WHERE weekend = 1) AS n_b,
       (avg(value) FILTER (WHERE weekend = 1) - avg(value) FILTER (WHERE weekend = 0))
         / avg(value) FILTER (WHERE weekend = 0) * 100.0 AS uplift_pct
FROM clean""", floats=["mean_a", "mean_b", "uplift_pct"], ints=["n_a", "n_b"])
def weekend_uplift(spark, sf_dir):
    """Weekend vs weekday mean (the weekday-uplift claim)."""
    return prof.uplift(clean_events(spark, sf_dir), "weekend", "value")


# ----------------------------------------------------------------- head / types / findings
@register("head_events", CLEAN_EVENTS_SQL + "\nSELECT * FROM clean ORDER BY ts, event_id LIMIT 10",
          floats=["value"], ints=CLEAN_INTS, times=["ts"])
def head_events(spark, sf_dir):
    """The first ten cleaned rows in time order (a top-k, not a scan cap)."""
    return clean_events(spark, sf_dir).orderBy("ts", "event_id").limit(10)


_TYPES = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
          ("value", "double"))


@register("type_profile", "WITH " + RAW_EVENTS_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 1) AS null_pct FROM nulled"
    for c, t in _TYPES), floats=["null_pct"], ints=["nulls"])
def type_profile(spark, sf_dir):
    """A2: column types with null counts and shares."""
    return prof.type_profile(nullify_sentinel(sensor_events(spark, sf_dir), ["value"]))


_FINDINGS_SQL = CLEAN_EVENTS_SQL + """,
a AS (SELECT count(*) AS rows,
             avg(value) FILTER (WHERE is_rush_hour = 0) AS off, avg(value) FILTER (WHERE is_rush_hour = 1) AS on_,
             avg(value) FILTER (WHERE weekend = 0) AS wd, avg(value) FILTER (WHERE weekend = 1) AS we,
             avg(CAST(is_rush_hour AS DOUBLE)) AS rush_share, avg(CAST(high_pollution AS DOUBLE)) AS high_share,
             var_samp(value) FILTER (WHERE is_rush_hour = 0) AS v_off,
             var_samp(value) FILTER (WHERE is_rush_hour = 1) AS v_on FROM clean),
m AS (
  SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value, NULL::DOUBLE AS claim_low, NULL::DOUBLE AS claim_high FROM a
  UNION ALL SELECT 'columns', 13.0, NULL, NULL FROM a
  UNION ALL SELECT 'rush_uplift_pct', (on_ - off) / off * 100.0, 30.0, 40.0 FROM a
  UNION ALL SELECT 'weekday_uplift_pct', (wd - we) / we * 100.0, 20.0, 30.0 FROM a
  UNION ALL SELECT 'rush_share_pct', rush_share * 100.0, 20.0, 30.0 FROM a
  UNION ALL SELECT 'high_class_pct', high_share * 100.0, 45.0, 55.0 FROM a
  UNION ALL SELECT 'cohens_d_rush', (on_ - off) / sqrt((v_off + v_on) / 2), NULL, NULL FROM a)
SELECT metric, value, claim_low, claim_high,
       CASE WHEN claim_low IS NULL THEN 'n/a' WHEN value >= claim_low AND value <= claim_high THEN 'held'
            ELSE 'not held' END AS held
FROM m"""


@register("findings", _FINDINGS_SQL, floats=["value", "claim_low", "claim_high"])
def findings_q(spark, sf_dir):
    """Every dashboard claim recomputed from the data, held or not."""
    from .report import findings
    return findings(clean_events(spark, sf_dir))


@register("season_month_rollup", """
SELECT season, month, avg(o_totalprice) AS mean_o_totalprice, count(*) AS n, grouping(season, month) AS level
FROM (SELECT CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
                  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer'
                  WHEN month(o_orderdate) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS season,
             strftime(o_orderdate, '%b') AS month, o_totalprice FROM orders)
GROUP BY ROLLUP (season, month)""",
          floats=["mean_o_totalprice"], ints=["n", "level"])
def season_month_rollup(spark, sf_dir):
    """A11/A12 + P9 with subtotals: season x month means, season totals, grand total."""
    from ..functions.scalar import month_name, season
    o = read_table(spark, sf_dir, "orders").select(
        season(F.month("o_orderdate")).alias("season"), month_name(F.month("o_orderdate")).alias("month"),
        "o_totalprice")
    return prof.group_means(o, ["season", "month"], ["o_totalprice"], rollup=True)


@register("distinct_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM events"
    for c in ("user_id", "event_type", "event_id")), ints=["n_distinct"])
def distinct_counts(spark, sf_dir):
    """A1 group sizes: distinct series, users and events in one pass."""
    return prof.distinct_counts(read_table(spark, sf_dir, "events"), ["user_id", "event_type", "event_id"])
