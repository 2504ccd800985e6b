"""Evaluation operators: ROC/AUC identities, confusion matrix and report."""
import numpy as np
import pandas as pd
import pytest

from hourglass.operators import evaluate as ev


def _pred(spark, n=2000, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    score = np.round(y * 0.7 + rng.normal(scale=0.6, size=n), 1)     # rounded: many ties
    pred = (score > 0.35).astype(int)
    return pd.DataFrame({"label": y, "score": score, "prediction": pred}), spark.createDataFrame(
        pd.DataFrame({"label": y, "score": score, "prediction": pred}))


def test_auc_equals_trapezoid_and_rank_statistic(spark):
    pdf, df = _pred(spark)
    roc = ev.roc_curve(df, partitions=5).orderBy("threshold", ascending=False).toPandas()
    fpr, tpr = np.r_[0.0, roc.fpr], np.r_[0.0, roc.tpr]
    trap = np.trapezoid(tpr, fpr)
    auc = ev.auc(df).first().auc
    pos, neg = pdf.score[pdf.label == 1].to_numpy(), pdf.score[pdf.label == 0].to_numpy()
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(trap, abs=1e-12) and auc == pytest.approx(mw, abs=1e-12)
    assert roc.tps.is_monotonic_increasing and roc.tpr.iloc[-1] == 1.0


def test_confusion_and_report(spark):
    pdf, df = _pred(spark)
    cm = {(r.actual, r.predicted): r["count"] for r in ev.confusion_matrix(df).collect()}
    for a in (0, 1):
        for p in (0, 1):
            assert cm[(a, p)] == int(((pdf.label == a) & (pdf.prediction == p)).sum())
    rep = {r["class"]: r for r in ev.classification_report(df).collect()}
    tp = cm[(1, 1)]
    prec1, rec1 = tp / (tp + cm[(0, 1)]), tp / (tp + cm[(1, 0)])
    assert rep["1"].precision == pytest.approx(prec1) and rep["1"].recall == pytest.approx(rec1)
    assert rep["accuracy"].f1 == pytest.approx((pdf.label == pdf.prediction).mean())
    bm = ev.binary_metrics(df).first()
    assert bm.f1 == pytest.approx(2 * prec1 * rec1 / (prec1 + rec1))


def test_regression_metrics(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=500)
    p = y + rng.normal(scale=0.3, size=500)
    r = ev.regression_metrics(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    assert r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-10)
    assert r.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()), rel=1e-10)
