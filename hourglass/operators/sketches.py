"""Stored sketches: profiles of any span of days without reading the data again (A3, M1, M2 approximate).

A day's row of a column holds counts, extremes, moments, a KLL quantile sketch and an HLL distinct sketch.  Rows merge: new readings of a
known day are merged into it, and any span of days is merged into one profile.  Counts, extremes, mean and deviation are exact;
a quantile's rank is off by at most about ``rank_error(k)`` of the rows (99 % confidence), a distinct count by about
``distinct_error(lg)`` (one standard error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_of, ratio

QUANTILE_K, DISTINCT_LG = 1000, 12


def rank_error(k: int = QUANTILE_K) -> float:
    """Normalised rank error of a quantile query (published fit for this sketch)."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = DISTINCT_LG) -> float:
    return 1.04 / 2 ** (lg / 2)


_PARTS = ["n", "nulls", "low", "high", "mean", "m2", "quantiles", "distinct"]


def daily_sketches(df: DataFrame, ts: str, cols: Sequence[str], keys: Sequence[str] = (), k: int = QUANTILE_K, lg: int = DISTINCT_LG) -> DataFrame:
    """``day, *keys, column`` and the parts: one scan, one partial aggregate for all columns.  NaN counts as NULL; rows without a time
    have the day NULL."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.nanvl(col_of(c).cast("double"), F.lit(None))
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"nulls{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"),
                 F.avg(x).alias(f"mean{i}"), (F.var_pop(x) * F.count(x)).alias(f"m2{i}"), F.kll_sketch_agg_double(x, F.lit(k)).alias(f"quantiles{i}"),
                 F.hll_sketch_agg(x.cast("string"), F.lit(lg)).alias(f"distinct{i}")]
    wide = df.groupBy(col_of(ts).cast("date").alias("day"), *keys).agg(*aggs)
    return wide.select("day", *keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(p) for p in _PARTS]) for i, c in enumerate(cols)])))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of equal ``by`` as one."""
    some = F.col("n") > 0
    n, first = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    mean = ratio(first, n)
    spread = F.sum(F.when(some, F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))) - ratio(first * first, n)
    return sketches.groupBy(*by).agg(
        n.alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"),
        F.greatest(spread, F.lit(0.0)).alias("m2"), F.kll_merge_agg_double(F.when(some, F.col("quantiles"))).alias("quantiles"),
        F.hll_union_agg(F.when(some, F.col("distinct"))).alias("distinct"))


def updated(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The stored table after ``new`` sketches: their days are merged, late readings of a known day included."""
    return merged(stored.unionByName(new), ["day", *keys, "column"])


def span_profile(sketches: DataFrame, start=None, end=None, keys: Sequence[str] = (), probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Profile of the days from ``start`` to ``end`` (both included; None: open): ``*keys, column``, counts, ``missing_pct``,
    moments, extremes, ``q<per cent>`` and ``distinct``."""
    rows = sketches
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    one, some = merged(rows, [*keys, "column"]), F.col("n") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"q{p * 100:g}") for p in probabilities]
    return one.select(*keys, "column", "n", "nulls", F.bround(ratio(F.col("nulls") * 100.0, F.col("n") + F.col("nulls")), 1).alias("missing_pct"),
                      "mean", F.sqrt(ratio(F.col("m2"), F.col("n") - 1)).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"),
                      *quantiles, F.when(some, F.hll_sketch_estimate("distinct")).otherwise(0).alias("distinct"))
