"""Model evaluation as DataFrame operators.

Every metric is an aggregation over (label, prediction[, score]) columns, so
it runs where the predictions are and needs no driver-side data.  The ROC
curve needs cumulative sums in score order; they are computed per range
partition plus one small offset per partition, never in a single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_of, ratio
from ..session import cut_lineage


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       keys: Sequence[str] = ()) -> DataFrame:
    """R^2, MAE, RMSE in one pass (SST = n * var_pop(y))."""
    y, p = col_of(label).cast("double"), col_of(prediction).cast("double")
    err = y - p
    return pred.groupBy(*keys).agg(
        F.count(err).cast("bigint").alias("n"),
        (1.0 - ratio(F.sum(err * err), F.count(err) * F.var_pop(F.when(err.isNotNull(), y)))).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))


def residual_summary(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Residual mean and population std, actual/predicted ranges."""
    y, p = col_of(label).cast("double"), col_of(prediction).cast("double")
    r = y - p
    return pred.agg(F.avg(r).alias("resid_mean"), F.stddev_pop(r).alias("resid_std"),
                    F.min(y).alias("actual_min"), F.max(y).alias("actual_max"),
                    F.min(p).alias("pred_min"), F.max(p).alias("pred_max"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts for every (actual, predicted) class pair, zeros included."""
    counts = pred.groupBy(col_of(label).cast("int").alias("actual"),
                          col_of(prediction).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = pred.sparkSession.createDataFrame([(a, b) for a in classes for b in classes],
                                             "actual int, predicted int")
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Per-class precision/recall/f1/support, accuracy, macro and weighted avg."""
    y, p = col_of(label).cast("int"), col_of(prediction).cast("int")
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(y == p).alias("correct")]
    for c in classes:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"pp{c}"),
                 F.count_if(y == c).alias(f"sup{c}")]
    one = pred.agg(*aggs)
    rows = []
    for c in classes:
        prec = F.when(F.col(f"pp{c}") > 0, F.col(f"tp{c}") / F.col(f"pp{c}")).otherwise(F.lit(0.0))
        rec = F.when(F.col(f"sup{c}") > 0, F.col(f"tp{c}") / F.col(f"sup{c}")).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append((str(c), prec, rec, f1, F.col(f"sup{c}")))
    per_class = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("class"), a.alias("precision"), b.alias("recall"), c.alias("f1"),
                 d.cast("bigint").alias("support")) for n, a, b, c, d in rows])),
        F.col("total"), F.col("correct"))
    summary = per_class.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        ratio(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").alias("n"),
        ratio(F.first("correct"), F.first("total")).alias("acc"))
    extra = summary.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                 F.col("n").cast("bigint").alias("support")))))
    return per_class.drop("total", "correct").unionByName(extra)


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and F1 of the positive class."""
    y, p = col_of(label).cast("int"), col_of(prediction).cast("int")
    tp, fp, fn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    return pred.agg(ratio(F.count_if(y == p), F.count(F.lit(1))).alias("accuracy"),
                    F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"))


def _score_counts(pred: DataFrame, label: str, score: str) -> DataFrame:
    y = col_of(label).cast("int")
    return pred.filter(col_of(score).isNotNull()).groupBy(col_of(score).cast("double").alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def _roc_table(pred: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    spark = pred.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc = _score_counts(pred, label, score)
    ranged = sc.repartitionByRange(partitions, F.desc("threshold")).withColumn("pid", F.spark_partition_id())
    # written once: the two branches below must see the same partitions, and range bounds are sampled per run
    ranged = cut_lineage(ranged)
    w = Window.partitionBy("pid").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("pid").orderBy(F.desc("threshold"))
    local = ranged.withColumns({"ltp": F.sum("pos").over(w), "lfp": F.sum("neg").over(w),
                                "later": F.lead(F.struct("pos", "neg")).over(after)})
    tot = ranged.groupBy("pid").agg(F.sum("pos").alias("ppos"), F.sum("neg").alias("pneg"),
                                    F.max_by(F.struct("pos", "neg"), "threshold").alias("head"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, not the data
    offsets = tot.select("pid",
                         F.coalesce(F.sum("ppos").over(before), F.lit(0)).alias("otp"),
                         F.coalesce(F.sum("pneg").over(before), F.lit(0)).alias("ofp"),
                         F.lead("head").over(Window.orderBy("pid")).alias("next_head"),
                         F.sum("ppos").over(Window.partitionBy()).alias("P"),
                         F.sum("pneg").over(Window.partitionBy()).alias("N"))
    return local.join(F.broadcast(offsets), "pid").select(
        "threshold", "pos", "neg", (F.col("ltp") + F.col("otp")).alias("tps"),
        (F.col("lfp") + F.col("ofp")).alias("fps"), "P", "N", F.coalesce("later", "next_head").alias("later"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score",
              partitions: int | None = None) -> DataFrame:
    """The ROC curve from its (0, 0) start (threshold infinite) on, without
    the points that lie on a straight line between their neighbours.

    tps/fps are the positives/negatives with score >= threshold.  Scores are
    first reduced to one row per distinct value; cumulative sums then run per
    range partition (descending score) with an offset per partition.
    """
    t = _roc_table(pred, label, score, partitions)
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    turns = (F.col("later.pos") != F.col("pos")) | (F.col("later.neg") != F.col("neg"))
    point = F.struct(F.col("threshold").alias("threshold"), F.col("tps").alias("tps"), F.col("fps").alias("fps"))
    start = F.struct(F.lit(math.inf).alias("threshold"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"))
    kept = t.where(first | F.col("later").isNull() | turns)
    t = kept.select("P", "N", F.inline(F.when(first, F.array(start, point)).otherwise(F.array(point))))
    return t.select("threshold", F.col("tps").cast("bigint").alias("tps"),
                    F.col("fps").cast("bigint").alias("fps"),
                    ratio("tps", "P").alias("tpr"), ratio("fps", "N").alias("fpr"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E5: exact ROC AUC = P(score_pos > score_neg) + 0.5 P(tie); equals the
    trapezoid area under ``roc_curve``."""
    t = _roc_table(pred, label, score)
    neg_below = F.col("N") - F.col("fps")
    return t.agg(ratio(F.sum(F.col("pos").cast("double") * (neg_below + 0.5 * F.col("neg"))),
                       F.first("P").cast("double") * F.first("N")).alias("auc"))
