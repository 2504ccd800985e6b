"""Sources (S1, S2) and the driver's test tables."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


class SourceMissing(FileNotFoundError):
    """The input file is not there."""


@contextmanager
def _present(path: str):
    """Spark's own file system decides whether a path is there: local, shared or remote."""
    try:
        yield
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise SourceMissing(f"input not found: {path}") from e
        raise


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",", header: bool = True, infer: bool = False) -> DataFrame:
    """CSV scan with an explicit schema (inference only when asked)."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    with _present(path):
        return reader.option("mode", "PERMISSIVE").csv(path)


def read_csv_known(spark: SparkSession, path: str, known: T.StructType, sep: str = ",") -> DataFrame:
    """S1 for files with extra, unnamed columns: the header names the columns;
    known names get their declared types, any other column is read as text
    (and can then be dropped by prefix, S3)."""
    with _present(path):
        header = spark.read.option("header", True).option("sep", sep).csv(path).columns   # header line only
    types = {f.name: f.dataType for f in known.fields}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return read_csv(spark, path, schema, sep=sep)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    with _present(path):
        return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables in ``sf_dir``."""
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


# --- fixed values: columns of the hourly air-quality CSV the dashboard reads ---
AIR_QUALITY_SCHEMA = T.StructType(
    [T.StructField("Date", T.StringType()), T.StructField("Time", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "CO(GT)", "PT08.S1(CO)", "NMHC(GT)", "C6H6(GT)", "PT08.S2(NMHC)", "NOx(GT)",
        "PT08.S3(NOx)", "NO2(GT)", "PT08.S4(NO2)", "PT08.S5(O3)", "T", "RH", "AH")]
)
