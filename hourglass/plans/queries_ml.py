"""Model training / evaluation / scoring queries (F, R, K, E, X, S6)."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import ml
from ..operators.profile import histogram
from ..operators.quantiles import medians
from ..operators.score import scenario_grid, score_scenarios
from ..session import ensure_checkpoint_dir
from ..sources.readers import read_table
from .catalog import register
from .queries_profile import _hist_sql

FEATURES = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size", "l_linenumber",
            "ship_month", "ship_weekday", "ship_weekend"]
KEYS = ["l_orderkey", "l_linenumber"]
REG_LABEL = "l_extendedprice"
CLS_LABEL = "high_price"


def _ml_base(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        F.month("l_shipdate").alias("ship_month"), F.weekday("l_shipdate").alias("ship_weekday"),
        (F.weekday("l_shipdate") >= 5).cast("int").alias("ship_weekend"))
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice",
                                                    "p_size")
    return li.join(part, "l_partkey")


def ml_frame(spark, sf_dir):
    """lineitem joined to part, calendar features of the ship date and the
    median-threshold class label (A15)."""
    df = _ml_base(spark, sf_dir)
    med = medians(df, [REG_LABEL])[REG_LABEL]
    return df.withColumn(CLS_LABEL, (F.col(REG_LABEL) > F.lit(med)).cast("int"))


_CACHE: dict = {}
_LOCKS: dict = {}
_LOCK = threading.Lock()


def trained(spark, sf_dir, kind: str):
    """Fit (once per session and input) every model of one kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    with _LOCK:
        mine = _LOCKS.setdefault(key, threading.Lock())
    with mine:                                  # a second caller waits for the first one's fit
        if key not in _CACHE:
            for old in [k for k in _CACHE if k[0] != key[0]]:
                del _CACHE[old]                 # of an application that has ended
            _CACHE[key] = _train(spark, sf_dir, kind)
        return _CACHE[key]


def _train(spark, sf_dir, kind):
    ensure_checkpoint_dir(spark)
    df = ml_frame(spark, sf_dir)
    train, test = ml.hash_split(df, KEYS)
    label = REG_LABEL if kind == "regression" else CLS_LABEL
    train, n = ml.prepared(train.withColumn("label", F.col(label).cast("double")))
    test = test.withColumn("label", F.col(label).cast("double")).persist()
    base = ml.feature_stages(train, FEATURES)
    if kind == "regression":
        sd = train.agg(F.stddev_pop("label")).first()[0]
        models = ml.regressors(n, sd, FEATURES, keys=KEYS)
    else:
        models = ml.classifiers(n, FEATURES, keys=KEYS)
    results = ml.fit_all(models, base, train, test, kind)
    return results, train, test


def _with_counts(board, train, test):
    """The sizes behind a leaderboard."""
    return board.withColumns({"n_train": F.lit(train.count()), "n_test": F.lit(test.count()), "n_features": F.lit(len(FEATURES))})


@register("regression_leaderboard")
def regression_leaderboard(spark, sf_dir):
    """Six regressors trained in parallel, ranked by R^2."""
    results, train, test = trained(spark, sf_dir, "regression")
    return _with_counts(ml.leaderboard(spark, results, "regression").drop("train_seconds"), train, test)


@register("classification_leaderboard")
def classification_leaderboard(spark, sf_dir):
    """Classifiers ranked by F1 of the positive class."""
    results, train, test = trained(spark, sf_dir, "classification")
    return _with_counts(ml.leaderboard(spark, results, "classification").drop("train_seconds"), train, test)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Top-12 importances of the best tree regressor."""
    results, _, _ = trained(spark, sf_dir, "regression")
    trees = [r for r in results if r.name in ("Decision Tree", "Random Forest", "Gradient Boosting")]
    b = ml.best(trees, "regression")
    return ml.feature_importance(spark, b.model, FEATURES).withColumn("model", F.lit(b.name))


@register("classifier_importance")
def classifier_importance(spark, sf_dir):
    """Top-12 importances of the best tree classifier."""
    results, _, _ = trained(spark, sf_dir, "classification")
    trees = [r for r in results if r.name in ("Decision Tree", "Random Forest", "Gradient Boosting")]
    b = ml.best(trees, "classification")
    return ml.feature_importance(spark, b.model, FEATURES).withColumn("model", F.lit(b.name))


@register("best_model_report")
def best_model_report(spark, sf_dir):
    """E7/E8 on the best classifier's test predictions."""
    results, _, test = trained(spark, sf_dir, "classification")
    b = ml.best(results, "classification")
    return ev.classification_report(b.model.transform(test), "label", "prediction") \
        .withColumn("model", F.lit(b.name))


@register("best_model_roc")
def best_model_roc(spark, sf_dir):
    """E6 on the best classifier: one ROC point per distinct probability."""
    results, _, test = trained(spark, sf_dir, "classification")
    b = ml.best(results, "classification")
    return ev.roc_curve(ml.with_score(b.model.transform(test)), "label", "score")


@register("classifier_rocs")
def classifier_rocs(spark, sf_dir):
    """E6 per model: ROC points of every classifier that outputs probabilities."""
    from functools import reduce
    results, _, test = trained(spark, sf_dir, "classification")
    curves = [ev.roc_curve(ml.with_score(r.model.transform(test)), "label", "score")
              .withColumn("model", F.lit(r.name)) for r in results]
    return reduce(lambda a, b: a.unionByName(b), curves)


@register("best_model_residuals")
def best_model_residuals(spark, sf_dir):
    """Residual summary of the best regressor on the test rows."""
    results, _, test = trained(spark, sf_dir, "regression")
    b = ml.best(results, "regression")
    return ev.residual_summary(b.model.transform(test), "label", "prediction") \
        .withColumn("model", F.lit(b.name))


@register("learning_curve")
def learning_curve(spark, sf_dir):
    """3-fold learning curve over 8 training sizes of the best regressor
    (its estimator settings rebuilt for every training subset)."""
    results, train, _ = trained(spark, sf_dir, "regression")
    best = ml.best(results, "regression").name

    def stages(tr):
        n = tr.count()
        sd = tr.agg(F.stddev_pop("label")).first()[0]
        return ml.feature_stages(tr, FEATURES) + ml.regressors(n, sd, FEATURES, keys=KEYS)[best]

    order = [*KEYS, "l_partkey", REG_LABEL]
    return ml.learning_curve(train, stages, order).withColumn("model", F.lit(best))


@register("regression_residuals")
def regression_residuals(spark, sf_dir):
    """E9 for every regressor: actual-vs-predicted ranges and residual mean/std."""
    from functools import reduce
    results, _, test = trained(spark, sf_dir, "regression")
    parts = [ev.residual_summary(r.model.transform(test), "label", "prediction").withColumn("model", F.lit(r.name))
             for r in results]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("scenario_scores")
def scenario_scores(spark, sf_dir):
    """Best regressor + best classifier score a what-if grid built
    from the observed feature ranges; severity band and alert per scenario."""
    reg, _, _ = trained(spark, sf_dir, "regression")
    cls, _, _ = trained(spark, sf_dir, "classification")
    df = ml_frame(spark, sf_dir)
    grid = scenario_grid(df, {"l_quantity": 5, "p_retailprice": 5, "l_discount": 3},
                         fixed={"l_tax": "median", "p_size": "median", "l_linenumber": "median",
                                "ship_month": "median"},
                         calendar={"ship_weekday": [0, 5]})
    grid = grid.withColumn("ship_weekend", (F.col("ship_weekday") >= 5).cast("int"))
    med = medians(df, [REG_LABEL])[REG_LABEL]
    return score_scenarios(grid, ml.best(reg, "regression").model, ml.best(cls, "classification").model,
                           reference=med)


# ----------------------------------------------------------------- SQL-checkable evaluation
_ML_SQL = """
WITH m AS (SELECT l.*, p.p_retailprice, p.p_size FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
lab AS (SELECT *, CASE WHEN l_extendedprice > (SELECT median(l_extendedprice) FROM m) THEN 1 ELSE 0 END AS label,
               CASE WHEN l_quantity > (SELECT median(l_quantity) FROM m) THEN 1 ELSE 0 END AS prediction,
               CAST(l_quantity AS DOUBLE) AS score FROM m)"""


def _scored(spark, sf_dir):
    """Rule-based scores on the ML frame: score = quantity, prediction =
    quantity above its median; label = high price."""
    df = _ml_base(spark, sf_dir)
    med = medians(df, [REG_LABEL, "l_quantity"])      # both medians from the same passes
    return df.select((F.col(REG_LABEL) > F.lit(med[REG_LABEL])).cast("int").alias("label"),
                     F.col("l_quantity").cast("double").alias("score"),
                     (F.col("l_quantity") > F.lit(med["l_quantity"])).cast("int").alias("prediction"))


@register("roc_rule", _ML_SQL + """,
c AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
             count(*) FILTER (WHERE label <> 1) AS neg FROM lab GROUP BY score),
cum AS (SELECT threshold, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N, row_number() OVER o AS i, count(*) OVER () AS points,
               pos <> lead(pos) OVER o OR neg <> lead(neg) OVER o AS turns FROM c
        WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               o AS (ORDER BY threshold DESC))
SELECT threshold, tps, fps, tps / P AS tpr, fps / N AS fpr FROM cum WHERE i = 1 OR i = points OR turns
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0, 0""",
          floats=["threshold", "tpr", "fpr"], ints=["tps", "fps"])
def roc_rule(spark, sf_dir):
    """ROC points of a score column (distributed cumulative sums)."""
    return ev.roc_curve(_scored(spark, sf_dir), "label", "score")


@register("auc_rule", _ML_SQL + """,
c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM lab GROUP BY score),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
               sum(neg) OVER () AS N, sum(pos) OVER () AS P FROM c)
SELECT sum(pos * (N - fps + 0.5 * neg)) / (max(P) * max(N)) AS auc FROM cum""", floats=["auc"])
def auc_rule(spark, sf_dir):
    """E5: exact AUC with ties counted one half."""
    return ev.auc(_scored(spark, sf_dir), "label", "score")


@register("confusion_rule", _ML_SQL + """
SELECT a.actual, a.predicted, coalesce(c.count, 0) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted)) a
LEFT JOIN (SELECT label AS actual, prediction AS predicted, count(*) AS count FROM lab GROUP BY 1, 2) c
  ON a.actual = c.actual AND a.predicted = c.predicted""", ints=["actual", "predicted", "count"])
def confusion_rule(spark, sf_dir):
    """2 x 2 confusion matrix with zero cells kept."""
    return ev.confusion_matrix(_scored(spark, sf_dir), "label", "prediction")


@register("report_rule", _ML_SQL + """,
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = prediction) AS correct,
             count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tp0,
             count(*) FILTER (WHERE prediction = 0) AS pp0, count(*) FILTER (WHERE label = 0) AS sup0,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp1,
             count(*) FILTER (WHERE prediction = 1) AS pp1, count(*) FILTER (WHERE label = 1) AS sup1 FROM lab),
pc AS (SELECT '0' AS class, CASE WHEN pp0 > 0 THEN tp0 / pp0 ELSE 0 END AS precision,
              CASE WHEN sup0 > 0 THEN tp0 / sup0 ELSE 0 END AS recall, sup0 AS support FROM s
       UNION ALL
       SELECT '1', CASE WHEN pp1 > 0 THEN tp1 / pp1 ELSE 0 END, CASE WHEN sup1 > 0 THEN tp1 / sup1 ELSE 0 END,
              sup1 FROM s),
pf AS (SELECT class, precision, recall,
              CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
              support FROM pc)
SELECT * FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT correct / total FROM s), (SELECT sum(support) FROM pf)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pf
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM pf""",
          floats=["precision", "recall", "f1"], ints=["support"])
def report_rule(spark, sf_dir):
    """Classification report (per class, accuracy, macro, weighted)."""
    return ev.classification_report(_scored(spark, sf_dir), "label", "prediction")


@register("binary_metrics_rule", _ML_SQL + """
SELECT count(*) FILTER (WHERE label = prediction) / count(*) AS accuracy,
       2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
         / (2 * count(*) FILTER (WHERE label = 1 AND prediction = 1) + count(*) FILTER (WHERE label <> prediction))
         AS f1 FROM lab""", floats=["accuracy", "f1"])
def binary_metrics_rule(spark, sf_dir):
    """Accuracy and positive-class F1."""
    return ev.binary_metrics(_scored(spark, sf_dir), "label", "prediction")


HOLDOUT_FROM = "1999-01-01"
_FIT_SQL = f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k, regr_intercept(l_extendedprice, l_quantity) AS c
           FROM lineitem WHERE l_shipdate < TIMESTAMP '{HOLDOUT_FROM}'),
p AS (SELECT l_extendedprice AS label, k * l_quantity + c AS prediction
      FROM lineitem, f WHERE l_shipdate >= TIMESTAMP '{HOLDOUT_FROM}')"""


def _trend_pred(spark, sf_dir):
    """Fit y = k x + c on rows shipped before the hold-out date, predict the rest."""
    li = read_table(spark, sf_dir, "lineitem")
    cut = F.lit(HOLDOUT_FROM).cast("timestamp_ntz")
    fit = li.filter(F.col("l_shipdate") < cut).agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("k"),
        F.regr_intercept("l_extendedprice", "l_quantity").alias("c")).first()
    return li.filter(F.col("l_shipdate") >= cut).select(
        F.col("l_extendedprice").alias("label"),
        (F.lit(fit["k"]) * F.col("l_quantity") + F.lit(fit["c"])).alias("prediction"))


@register("trend_fit_metrics", _FIT_SQL + """
SELECT count(*) AS n, 1 - sum((label - prediction) * (label - prediction)) / (count(*) * var_pop(label)) AS r2,
       avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) * (label - prediction))) AS rmse
FROM p""", floats=["r2", "mae", "rmse"], ints=["n"])
def trend_fit_metrics(spark, sf_dir):
    """R^2 / MAE / RMSE of a simple one-variable fit (variance explained)."""
    return ev.regression_metrics(_trend_pred(spark, sf_dir))


@register("trend_residuals", _FIT_SQL + """
SELECT avg(label - prediction) AS resid_mean, stddev_pop(label - prediction) AS resid_std,
       min(label) AS actual_min, max(label) AS actual_max, min(prediction) AS pred_min,
       max(prediction) AS pred_max FROM p""",
          floats=["resid_mean", "resid_std", "actual_min", "actual_max", "pred_min", "pred_max"])
def trend_residuals(spark, sf_dir):
    """Residual summary of the same fit."""
    return ev.residual_summary(_trend_pred(spark, sf_dir))


_RESID_SQL = _FIT_SQL.replace("WITH ", "", 1)


@register("trend_residual_histogram", _hist_sql("resid", "r").replace("WITH d AS", "WITH " + _RESID_SQL.strip() + """,
resid AS (SELECT label - prediction AS r FROM p),
d AS""", 1), floats=["bin_lo", "bin_hi"], ints=["bin", "count"])
def trend_residual_histogram(spark, sf_dir):
    """40-bin histogram of the residuals of the same fit."""
    return histogram(_trend_pred(spark, sf_dir).select((F.col("label") - F.col("prediction")).alias("r")), "r", 40)


@register("trend_actual_vs_predicted", _FIT_SQL + """,
b AS (SELECT CAST(floor(label / 5000) AS BIGINT) AS actual_bin, CAST(floor(prediction / 5000) AS BIGINT) AS predicted_bin FROM p)
SELECT actual_bin, predicted_bin, count(*) AS count FROM b GROUP BY 1, 2""", ints=["actual_bin", "predicted_bin", "count"])
def trend_actual_vs_predicted(spark, sf_dir):
    """Actual against predicted values as counts of 5000-wide cells."""
    cell = lambda c: F.floor(F.col(c) / 5000).cast("bigint")
    return (_trend_pred(spark, sf_dir).groupBy(cell("label").alias("actual_bin"), cell("prediction").alias("predicted_bin"))
            .agg(F.count(F.lit(1)).alias("count")))
