"""Hand-computed checks of the column expressions."""
import datetime as dt

from pyspark.sql import functions as F

from hourglass.functions import scalar as S
from hourglass.operators.clean import (CleanSpec, clean, drop_prefixed, forward_fill, nullify_sentinel,
                                       with_datetime)
from hourglass.sources.readers import AIR_QUALITY_SCHEMA


def test_sentinel_int_and_double(spark):
    df = spark.createDataFrame([(1, -200, -200.0), (2, 5, float("nan")), (3, -199, 1.5)],
                               "id int, a int, b double")
    out = nullify_sentinel(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in out] == [(None, None), (5, None), (-199, 1.5)]


def test_parse_datetime_guards(spark):
    df = spark.createDataFrame([("3/10/2004", "18:00:00"), ("3/10/2004", None), ("13/40/2004", "18:00:00"),
                                (None, None), ("12/31/2004", "23:00:00")], "Date string, Time string")
    out = [r.ts for r in with_datetime(df, "Date", "Time").collect()]
    assert out == [dt.datetime(2004, 3, 10, 18, 0), dt.datetime(2004, 12, 31, 23, 0)]


def test_calendar_parts_and_flags(spark):
    days = [dt.datetime(2004, m, d, h) for (m, d, h) in
            [(3, 12, 6), (3, 13, 7), (3, 14, 9), (3, 15, 10), (6, 1, 16), (9, 1, 17), (12, 1, 19),
             (1, 1, 20), (2, 29, 8), (5, 31, 18), (8, 31, 0), (11, 30, 23)]]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    rows = df.select("ts", *[c.alias(n) for n, c in S.calendar_columns("ts").items()]).collect()
    for r in rows:
        assert r.weekday == r.ts.weekday()          # Monday = 0
        assert r.weekend == int(r.ts.weekday() >= 5)
        assert r.is_rush_hour == int(r.ts.hour in (7, 8, 9, 17, 18, 19))
        assert r.season == S.SEASON_OF_MONTH[r.ts.month]
        assert (r.hour, r.day, r.month) == (r.ts.hour, r.ts.day, r.ts.month)


def test_labels_and_bands(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 5.0, 5.5, 10.0, 10.5, -0.9)], "v double")
    out = df.select(S.bucket_label("v", S.VIF_BANDS, S.VIF_ELSE).alias("vif"),
                    S.bucket_label("v", S.EFFECT_BANDS, S.EFFECT_ELSE, absolute=True).alias("eff"),
                    S.severity_band("v").alias("sev"), S.skew_shape("v").alias("shape")).collect()
    assert [r.vif for r in out] == ["Low (<5)", "Low (<5)", "Medium (5-10)", "Medium (5-10)", "High (>10)",
                                    "Low (<5)"]
    assert out[5].eff == "Large (>0.8)" and out[5].shape == "Left-skewed"
    assert [r.sev for r in out[:3]] == ["Moderate", "Moderate", "High"]
    names = spark.range(7).select(S.day_name(F.col("id").cast("int")).alias("d")).collect()
    assert [r.d for r in names] == list(S.DAY_NAMES)


def test_drop_prefixed_and_clean_chain(spark):
    rows = [("3/10/2004", "18:00:00", 2.6, -200.0, 1.0), ("3/10/2004", "19:00:00", -200.0, 3.0, 1.0),
            ("3/10/2004", "20:00:00", 2.2, 1.0, 1.0), ("3/10/2004", "21:00:00", 1.6, 2.0, 1.0),
            (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "Date string, Time string, `CO(GT)` double, `NMHC(GT)` double, "
                                     "`Unnamed: 15` double")
    spec = CleanSpec(date_col="Date", time_col="Time", drop=["NMHC(GT)"], impute_cols=["CO(GT)"],
                     target="CO(GT)")
    out = clean(drop_prefixed(df), spec).orderBy("ts").collect()
    assert len(out) == 4
    assert "NMHC(GT)" not in out[0].asDict() and "Unnamed: 15" not in out[0].asDict()
    co = [r["CO(GT)"] for r in out]
    assert co == [2.6, 2.2, 2.2, 1.6]               # median of 2.6, 2.2, 1.6 fills the gap
    # strict '>' against the median: the filled row and the median row are class 0
    assert [r.high_pollution for r in out] == [1, 0, 0, 0]
    assert out[0].is_rush_hour == 1 and out[1].is_rush_hour == 1 and out[2].is_rush_hour == 0


def test_forward_fill_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("b", 1, 5.0), ("b", 2, None)],
                               "k string, t int, v double")
    out = forward_fill(df, ["v"], "t", ["k"]).orderBy("k", "t").collect()
    assert [r.v for r in out] == [None, 1.0, 1.0, 5.0, 5.0]


def test_air_quality_csv(spark, tmp_path):
    from hourglass.sources.readers import SourceMissing, read_csv
    p = tmp_path / "aq.csv"
    header = ",".join(f.name for f in AIR_QUALITY_SCHEMA.fields)
    p.write_text(header + "\n" + "3/10/2004,18:00:00," + ",".join(["-200"] * 13) + "\n")
    df = read_csv(spark, str(p), AIR_QUALITY_SCHEMA)
    assert df.count() == 1 and df.first()["CO(GT)"] == -200.0
    try:
        read_csv(spark, str(tmp_path / "missing.csv"), AIR_QUALITY_SCHEMA)
        raise AssertionError("expected SourceMissing")
    except SourceMissing:
        pass


def test_exports_roundtrip(spark, tmp_path):
    from hourglass.sources.writers import export_findings, export_table, with_partition_columns
    df = spark.createDataFrame([(dt.datetime(2024, m, 1), float(m)) for m in (1, 2, 2)], "ts timestamp_ntz, v double")
    out = str(tmp_path / "clean")
    export_table(with_partition_columns(df, "ts"), out, partition_by=["year", "month"])
    back = spark.read.parquet(out)
    assert back.count() == 3 and back.filter("month = 2").count() == 2
    csv = str(tmp_path / "clean_csv")
    export_table(df, csv, fmt="csv")
    assert spark.read.option("header", True).csv(csv).count() == 3
    fj = str(tmp_path / "findings")
    export_findings(spark.createDataFrame([("rows", 3.0)], "metric string, value double"), fj)
    assert spark.read.json(fj).count() == 1


def test_data_dictionary(spark):
    from hourglass.operators.profile import data_dictionary
    df = spark.createDataFrame([(1.0, 2.0)], "`CO(GT)` double, T double")
    dd = {r.column: r for r in data_dictionary(df, {"CO(GT)": ("target", "CO, reference analyser")}).collect()}
    assert dd["CO(GT)"].role == "target" and dd["T"].role == "other" and dd["T"].dtype == "double"
