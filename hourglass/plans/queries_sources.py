"""Source, sink and preparation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.clean import drop_columns, drop_prefixed, with_datetime
from ..operators.profile import sparse_columns
from ..session import ensure_checkpoint_dir
from ..sources.readers import read_csv, read_csv_known, read_table
from ..sources.writers import export_table
from ..spec import SeriesSpec
from .catalog import register


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
          floats=["o_totalprice"], ints=["o_orderkey"], times=["o_orderdate"])
def csv_round_trip(spark, sf_dir):
    """S4 + S1: orders exported as CSV with a header and scanned again with an explicit schema."""
    path = _scratch(spark, "orders-csv")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    export_table(read_table(spark, sf_dir, "orders").select(*cols), path, "csv")
    return read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")


@register("csv_unnamed_dropped", "SELECT s_suppkey, s_acctbal FROM supplier", floats=["s_acctbal"], ints=["s_suppkey"])
def csv_unnamed_dropped(spark, sf_dir):
    """S1 + S3: a file with unnamed columns, read by its header and cleaned by prefix."""
    path = _scratch(spark, "supplier-csv")
    src = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("x").alias("Unnamed: 1"), "s_acctbal", F.lit("").alias("Unnamed: 15"))
    export_table(src, path, "csv")
    known = src.select("s_suppkey", "s_acctbal").schema
    return drop_prefixed(read_csv_known(spark, path, known))


@register("parquet_by_month", """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n, sum(o_totalprice) AS total
FROM orders GROUP BY 1, 2""", floats=["total"], ints=["year", "month", "n"])
def parquet_by_month(spark, sf_dir):
    """The cleaned table written by year and month and read back from its partitions."""
    from ..sources.writers import with_partition_columns
    path = _scratch(spark, "orders-by-month")
    export_table(with_partition_columns(read_table(spark, sf_dir, "orders"), "o_orderdate"), path, partition_by=["year", "month"])
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@register("parsed_timestamps", """
SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1""",
          ints=["n"], times=["day"])
def parsed_timestamps(spark, sf_dir):
    """P3 + P4: date and time texts of every event, parsed again; a text that is no date would drop out."""
    raw = read_table(spark, sf_dir, "events").select(F.date_format("ts", "M/d/yyyy").alias("Date"), F.date_format("ts", "H:mm:ss").alias("Time"))
    return with_datetime(raw).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("sparse_dropped", """
SELECT event_id, value FROM events""", floats=["value"], ints=["event_id"])
def sparse_dropped(spark, sf_dir):
    """A column missing in over half of the rows is found and dropped, one missing in a tenth stays."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "value", F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("mostly_missing"))
    return drop_columns(ev, sparse_columns(ev, 50.0))


@register("column_group", "SELECT event_type, ts, value FROM events", floats=["value"], times=["ts"])
def column_group(spark, sf_dir):
    """The columns of a series by role."""
    spec = SeriesSpec(ts="ts", keys=("event_type",), targets=("value",))
    return spec.select(read_table(spark, sf_dir, "events"), "targets")


@register("rounded_prices", "SELECT o_orderkey, round_even(o_totalprice, 0) AS price FROM orders", floats=["price"], ints=["o_orderkey"])
def rounded_prices(spark, sf_dir):
    """Half-even rounding."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.bround("o_totalprice", 0).alias("price"))
