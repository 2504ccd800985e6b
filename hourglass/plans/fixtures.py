"""Derived inputs built from the driver's tables (same expressions as the SQL oracle).

* ``sensor_events``: ``events`` with the sentinel code injected into ``value``
  for every row whose ``event_id`` is a multiple of 11 (no row is dropped).
* ``series_events``: every event as a reading; many (type, hour) cells hold none,
  which exercises resample gaps, forward fill and the rolling warm-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import CleanSpec, clean
from ..sources.readers import read_table


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_id") % 11 == 0, F.lit(-200.0)).otherwise(F.col("value")).alias("value"))


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CleanSpec(ts="ts", sentinel_cols=["value"], impute_cols=["value"], target="value")
    return clean(sensor_events(spark, sf_dir), spec)


def series_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("ts", "event_type", "value")


def lineitem_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMERIC)


LINEITEM_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
