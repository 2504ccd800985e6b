"""Profiles from stored sketches (A3, M1, M2 approximate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as sk
from ..session import materialise
from ..sources.readers import read_table
from .catalog import register

START, END = "2024-01-05", "2024-01-20"


@register("sketch_span_profile", f"""
WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, user_id::DOUBLE AS user_id FROM events
           WHERE ts::DATE BETWEEN DATE '{START}' AND DATE '{END}'),
l AS (SELECT 'value' AS c, value AS x FROM e UNION ALL SELECT 'user_id', user_id FROM e)
SELECT c AS "column", count(x) AS n, count(*) - count(x) AS nulls, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
       true AS quartiles_hold, true AS distinct_holds FROM l GROUP BY c""", floats=["mean", "std", "min", "max"], ints=["n", "nulls"])
def sketch_span_profile(spark, sf_dir):
    """Sixteen days merged from daily sketches; quartiles and distinct counts are held against exact ranks and counts."""
    events = read_table(spark, sf_dir, "events").select("ts", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
                                                        F.col("user_id").cast("double").alias("user_id"))
    profile = materialise(sk.span_profile(sk.daily_sketches(events, "ts", ["value", "user_id"]), START, END))
    span = events.where(F.col("ts").cast("date").between(F.lit(START).cast("date"), F.lit(END).cast("date")))
    found = {r["column"]: r for r in profile.collect()}                       # a row a column
    checks = []
    for c, r in found.items():
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            checks.append(((F.avg((F.col(c) < r[name]).cast("double")) - sk.rank_error() <= p)
                           & (F.avg((F.col(c) <= r[name]).cast("double")) + sk.rank_error() >= p)).alias(f"{c}_{name}"))
        checks.append((F.abs(F.count_distinct(c) - r["distinct"]) <= 4 * sk.distinct_error() * F.count_distinct(c)).alias(f"{c}_distinct"))
    holds = span.agg(*checks).first()
    verdict = spark.createDataFrame([(c, all(holds[f"{c}_{q}"] for q in ("q25", "q50", "q75")), holds[f"{c}_distinct"]) for c in found],
                                    "column string, quartiles_hold boolean, distinct_holds boolean")
    return profile.select("column", "n", "nulls", "mean", "std", "min", "max").join(verdict, "column")
