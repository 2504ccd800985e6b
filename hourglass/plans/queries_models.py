"""Models on a target that can be learned: every model must reach a stated score (F, R, K, E1-E5, X2, X3, P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import severity_band
from ..operators import ml
from ..operators.linear import GramRegression
from ..operators.quantiles import medians
from ..operators.score import scenario_grid
from ..session import ensure_checkpoint_dir
from ..sources.readers import read_table
from .catalog import register

FEATURES = ["p_size", "p_retailprice"]
#: Least score on the held-out fifth: R^2, and accuracy.
LEAST_R2 = dict.fromkeys(["Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree", "Random Forest", "Gradient Boosting"], 0.95)
LEAST_ACCURACY = dict.fromkeys(["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting", "SVM", "KNN"], 0.9)


def _verdict_sql(least, condition):
    rows = ", ".join(f"('{m}')" for m in least)
    return f"""
WITH v AS (SELECT p_size * p_retailprice AS y FROM part), m AS (SELECT median(y) AS y FROM v)
SELECT model, (SELECT count(*) FILTER ({condition}) FROM v, m) AS n, true AS reached FROM (VALUES {rows}) AS t(model)"""


def _fitted(spark, sf_dir, kind):
    ensure_checkpoint_dir(spark)
    value = F.col("p_size") * F.col("p_retailprice")
    rows = read_table(spark, sf_dir, "part").withColumn("label", value)
    if kind == "classification":
        rows = rows.withColumn("label", (F.col("label") > medians(rows, ["label"])["label"]).cast("double"))
    train, test = ml.hash_split(rows, ["p_partkey"])
    train, n = ml.prepared(train)
    test = test.persist()
    models = (ml.regressors(n, train.agg(F.stddev_pop("label")).first()[0], FEATURES, keys=["p_partkey"]) if kind == "regression"
              else ml.classifiers(n, FEATURES, keys=["p_partkey"]))
    results = ml.fit_all(models, ml.feature_stages(train, FEATURES), train, test, kind)
    for d in (train, test):
        d.unpersist()
    return results, rows


def _verdict(spark, results, least, metric, n):
    rows = [(r.name, int(n), bool(r.metrics[metric] >= least[r.name])) for r in results]
    return spark.createDataFrame(rows, "model string, n long, reached boolean")


@register("regressors_on_parts", _verdict_sql(LEAST_R2, "WHERE v.y > 0"), ints=["n"])
def regressors_on_parts(spark, sf_dir):
    """R1-R6 on a product of two features: R^2 of each regressor on held-out rows against ``LEAST_R2``."""
    results, rows = _fitted(spark, sf_dir, "regression")
    return _verdict(spark, results, LEAST_R2, "r2", rows.where("label > 0").count())


@register("classifiers_on_parts", _verdict_sql(LEAST_ACCURACY, "WHERE v.y > m.y"), ints=["n"])
def classifiers_on_parts(spark, sf_dir):
    """K1-K6 on whether that product is above its median: accuracy against ``LEAST_ACCURACY``."""
    results, rows = _fitted(spark, sf_dir, "classification")
    return _verdict(spark, results, LEAST_ACCURACY, "accuracy", rows.where("label = 1").count())


_BANDS = ((25000.0, "Low"), (50000.0, "Moderate"), (55000.0, "High"))


@register("linear_scenarios", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k, regr_intercept(l_extendedprice, l_quantity) AS c, min(l_quantity) AS lo,
                  max(l_quantity) AS hi, median(l_extendedprice) AS reference FROM lineitem),
g AS (SELECT lo + (hi - lo) * i / 4 AS l_quantity, c + k * (lo + (hi - lo) * i / 4) AS predicted_value, reference FROM s, (SELECT unnest(range(0, 5)) AS i))
SELECT l_quantity, predicted_value, predicted_value - reference AS delta,
       CASE WHEN predicted_value <= 25000 THEN 'Low' WHEN predicted_value <= 50000 THEN 'Moderate' WHEN predicted_value <= 55000 THEN 'High'
            ELSE 'Very high' END AS band FROM g""", floats=["l_quantity", "predicted_value", "delta"])
def linear_scenarios(spark, sf_dir):
    """A grid over the observed range, scored by a linear model, with delta and severity band."""
    rows = read_table(spark, sf_dir, "lineitem")
    model = GramRegression(["l_quantity"], "l_extendedprice").fit(rows)
    reference = medians(rows, ["l_extendedprice"])["l_extendedprice"]
    out = model.transform(scenario_grid(rows, {"l_quantity": 5})).withColumnRenamed("prediction", "predicted_value")
    return out.select("l_quantity", "predicted_value", (F.col("predicted_value") - F.lit(reference)).alias("delta"),
                      severity_band("predicted_value", _BANDS).alias("band"))
