"""Scenario grid / scoring (X1-X3) and SeriesSpec role groups."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourglass.operators import ml
from hourglass.operators.score import scenario_grid, score_scenarios
from hourglass.spec import AIR_QUALITY, SeriesSpec


def test_scenario_grid_and_scoring(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.uniform(0, 10, 400), "b": rng.uniform(-1, 1, 400),
                        "c": rng.integers(0, 7, 400)})
    pdf["y"] = 2 * pdf.a + pdf.b
    pdf["cls"] = (pdf.y > pdf.y.median()).astype(int)
    df = spark.createDataFrame(pdf)
    grid = scenario_grid(df, {"a": 4, "b": 3}, fixed={"c": "median"}, calendar={"wd": [0, 5]})
    rows = grid.collect()
    assert len(rows) == 4 * 3 * 2
    assert min(r.a for r in rows) == pdf.a.min() and max(r.a for r in rows) == pdf.a.max()
    assert {r.c for r in rows} == {float(np.median(pdf.c))}
    reg = ml.fit_one("lr", ml.feature_stages(df, ["a", "b"]) + [ml.LinearRegression(regParam=0.0)],
                     df.withColumn("label", F.col("y")), df.withColumn("label", F.col("y")), "regression").model
    clf = ml.fit_one("lg", ml.feature_stages(df, ["a", "b"]) + [ml.LogisticRegression()],
                     df.withColumn("label", F.col("cls").cast("double")),
                     df.withColumn("label", F.col("cls").cast("double")), "classification").model
    out = score_scenarios(grid, reg, clf, reference=10.0).collect()
    for r in out:
        assert abs(r.predicted_value - (2 * r.a + r.b)) < 1e-6
        assert r.delta_vs_reference == r.predicted_value - 10.0 and r.alert == r.predicted_class
        assert 0.0 <= r.p_high <= 1.0 and r.band in ("Low", "Moderate", "High", "Very high")


def test_series_spec_roles(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "`CO(GT)` double, T double, `PT08.S1(CO)` double, x double")
    spec = SeriesSpec(ts="x", targets=["CO(GT)"], covariates=["T"], sensors=["PT08.S1(CO)"])
    assert spec.select(df, "targets").columns == ["x", "CO(GT)"]
    assert spec.roles()["T"][0] == "covariate"
    assert AIR_QUALITY.group("targets")[0] == "CO(GT)"
