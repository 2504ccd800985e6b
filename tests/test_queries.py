"""Driver contract: entry(), every query runs, oracle SQL agrees (small scale)."""
import os
import sys

import duckdb
import pandas as pd
import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
HEAVY = {"regression_leaderboard", "classification_leaderboard", "feature_importance", "best_model_report",
         "best_model_roc", "best_model_residuals", "scenario_scores", "learning_curve", "classifier_rocs",
         "regression_residuals", "classifier_importance"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 24 and "mean_value" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_agrees(spark, duck, name):
    ours = _norm(E.queries()[name](spark, SF_SMALL).toPandas())
    theirs = _norm(duck.execute(E.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert [str(t) for t in ours.dtypes] == [str(t) for t in theirs.dtypes]
    pd.testing.assert_frame_equal(ours, theirs, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - HEAVY))
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_partition_count_invariance(spark):
    names = ["describe_lineitem", "histogram_by_segment", "decompose_by_type", "roc_rule", "qq_points"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = {}
        for p in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            res[p] = {n: _norm(E.queries()[n](spark, SF_SMALL).toPandas()) for n in names}
        for n in names:
            pd.testing.assert_frame_equal(res["1"][n], res["7"][n])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_model_queries_run(spark):
    """The registered training queries share one fit per session and input."""
    qs = E.queries()
    for name in sorted(HEAVY):
        df = qs[name](spark, SF_SMALL)
        assert df.count() >= 1, name
    lb = qs["regression_leaderboard"](spark, SF_SMALL).collect()
    assert sorted(r["rank"] for r in lb) == list(range(1, 7))
    assert qs["classification_leaderboard"](spark, SF_SMALL).count() == 5
