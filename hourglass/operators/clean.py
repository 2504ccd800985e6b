"""Cleaning: sentinel codes, sparse columns, timestamps, calendar features,
median imputation and the median-threshold target (P1-P8, M1, M5, A15)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import (RUSH_HOURS, SENTINEL, calendar_columns, col_of,
                                parse_datetime, sentinel_to_null)
from .quantiles import medians

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def drop_prefixed(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    """S3: drop junk columns whose name starts with ``prefix``."""
    return df.select([col_of(c) for c in df.columns if not c.startswith(prefix)])


def nullify_sentinel(df: DataFrame, cols: Sequence[str] | None = None,
                     sentinel: float = SENTINEL) -> DataFrame:
    """Sentinel code and NaN -> NULL in every numeric column (or ``cols``)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    wanted = set(cols)
    return df.select([
        sentinel_to_null(c).cast(df.schema[c].dataType).alias(c) if c in wanted else col_of(c)
        for c in df.columns])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop named columns when present."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present) if present else df


def with_datetime(df: DataFrame, date_col: str = "Date", time_col: str = "Time",
                  out: str = "ts", fmt: str = "M/d/yyyy H:mm:ss") -> DataFrame:
    """P3 + P4: parse date/time strings, drop rows whose timestamp is missing."""
    return (df.withColumn(out, parse_datetime(date_col, time_col, fmt))
              .filter(F.col(out).isNotNull()))


def add_calendar(df: DataFrame, ts: str = "ts", rush_hours: Sequence[int] = RUSH_HOURS,
                 prefix: str = "") -> DataFrame:
    """Calendar parts, weekend, season and rush-hour flag."""
    return df.withColumns(calendar_columns(ts, prefix, rush_hours))


@dataclass
class MedianImputer:
    """M1: fill NULLs with each column's median (fitted on ``fit``'s input)."""

    cols: Sequence[str] | None = None
    method: str = "select"
    medians_: dict[str, float | None] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MedianImputer":
        cols = list(self.cols) if self.cols is not None else numeric_columns(df)
        self.medians_ = medians(df, cols, self.method)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fills = {c: v for c, v in self.medians_.items() if v is not None and c in df.columns}
        return df.select([
            F.coalesce(col_of(c), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
            if c in fills else col_of(c) for c in df.columns])


def impute_median(df: DataFrame, cols: Sequence[str] | None = None,
                  method: str = "select") -> DataFrame:
    return MedianImputer(cols, method).fit(df).transform(df)


def add_threshold_target(df: DataFrame, col: str, out: str = "high_pollution",
                         threshold: float | None = None, method: str = "select") -> DataFrame:
    """1 when ``col`` is strictly above its median (or ``threshold``)."""
    if threshold is None:
        threshold = medians(df, [col], method)[col]
    return df.withColumn(out, (col_of(col) > F.lit(threshold)).cast("int"))


def forward_fill(df: DataFrame, cols: Sequence[str], ts: str = "ts",
                 keys: Sequence[str] = ()) -> DataFrame:
    """M5: carry the last non-NULL value forward within each key, in time order.

    Meant for bucketed series (one row per key and period), so each window
    partition holds one key's buckets, not raw rows.
    """
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(ts) \
        .rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(col_of(c), ignorenulls=True).over(w) for c in cols})


@dataclass
class CleanSpec:
    """What ``clean`` does to a raw table (defaults follow the dashboard)."""

    ts: str = "ts"
    date_col: str | None = None           # set with time_col to parse strings
    time_col: str | None = None
    sentinel: float = SENTINEL
    sentinel_cols: Sequence[str] | None = None
    drop: Sequence[str] = ()
    drop_prefix: str | None = "Unnamed"
    impute_cols: Sequence[str] | None = None
    impute_exclude: Sequence[str] = ()
    target: str | None = None
    target_out: str = "high_pollution"
    rush_hours: Sequence[int] = RUSH_HOURS
    quantile_method: str = "select"


def clean(raw: DataFrame, spec: CleanSpec) -> DataFrame:
    """Whole cleaning chain: S3 -> P1 -> P2 -> P3/P4 -> P5-P8 -> M1 -> A15."""
    df = drop_prefixed(raw, spec.drop_prefix) if spec.drop_prefix else raw
    df = nullify_sentinel(df, spec.sentinel_cols, spec.sentinel)
    df = drop_columns(df, spec.drop)
    if spec.date_col and spec.time_col:
        df = with_datetime(df, spec.date_col, spec.time_col, spec.ts)
    else:
        df = df.filter(F.col(spec.ts).isNotNull())
    df = add_calendar(df, spec.ts, spec.rush_hours)
    cols = (list(spec.impute_cols) if spec.impute_cols is not None
            else numeric_columns(df, exclude=spec.impute_exclude))
    imputer = MedianImputer(cols, spec.quantile_method).fit(df)
    df = imputer.transform(df)
    if spec.target:
        # filling NULLs with the median leaves the median unchanged (the copies
        # sit in the middle of the order), so the fitted value is reused
        fractional = isinstance(df.schema[spec.target].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        known = imputer.medians_.get(spec.target) if fractional else None
        df = add_threshold_target(df, spec.target, spec.target_out, threshold=known,
                                  method=spec.quantile_method)
    return df
