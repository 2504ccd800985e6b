"""Exact trees and fully grown forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trees import ExactTree, GrownForest
from ..sources.readers import read_table
from .catalog import register

TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]

# every split of every feature by prefix sums over the distinct values; level by level for two levels
_SPLIT_SQL = """
u{i} AS (SELECT path, unnest([0, 1, 2]) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v, y FROM d{i}),
c{i} AS (SELECT path, feature, v, count(*) AS n, sum(y) AS s FROM u{i} GROUP BY ALL),
w{i} AS (SELECT path, feature, v, lead(v) OVER o AS w, sum(n) OVER o AS ln, sum(s) OVER o AS ls,
                sum(n) OVER (PARTITION BY path, feature) AS tn, sum(s) OVER (PARTITION BY path, feature) AS ts
         FROM c{i} WINDOW o AS (PARTITION BY path, feature ORDER BY v)),
s{i} AS (SELECT path, feature, v + (w - v) / 2 AS threshold,
                row_number() OVER (PARTITION BY path ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, feature, v) AS r
         FROM w{i} WHERE w IS NOT NULL),
b{i} AS (SELECT path, feature, threshold FROM s{i} WHERE r = 1)"""
_NEXT_SQL = """
d{j} AS (SELECT path || CASE WHEN [l_quantity, l_discount, l_tax][feature + 1] <= threshold THEN 'L' ELSE 'R' END AS path,
                l_quantity, l_discount, l_tax, y FROM d{i} JOIN b{i} USING (path))"""
_TREE_SQL = ("WITH d0 AS (SELECT '' AS path, l_quantity, l_discount, l_tax, {label} AS y FROM lineitem)," + _SPLIT_SQL.format(i=0) + ","
             + _NEXT_SQL.format(i=0, j=1) + "," + _SPLIT_SQL.format(i=1) + "," + _NEXT_SQL.format(i=1, j=2) + """
SELECT path, coalesce(feature, -1) AS feature, threshold, n, mean FROM (
  SELECT path, count(*) AS n, avg(y) AS mean FROM (SELECT path, y FROM d0 UNION ALL SELECT path, y FROM d1 UNION ALL SELECT path, y FROM d2) GROUP BY path)
LEFT JOIN (SELECT * FROM b0 UNION ALL SELECT * FROM b1) USING (path)""")


def _tree_rows(spark, model):
    tree, rows, todo = model.tree, [], [(0, "")]
    for node, path in todo:
        split = tree.feature[node] >= 0
        rows.append((path, tree.feature[node], tree.threshold[node] if split else None, int(tree.rows[node]), tree.value[node]))
        todo += [(tree.left[node], path + "L"), (tree.right[node], path + "R")] if split else []
    return spark.createDataFrame(rows, "path string, feature int, threshold double, n long, mean double")


@register("exact_regression_tree", _TREE_SQL.replace("{label}", "l_extendedprice"), floats=["threshold", "mean"], ints=["feature", "n"])
def exact_regression_tree(spark, sf_dir):
    """Two levels of the tree that looks at every threshold, against every split in SQL."""
    rows = read_table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_extendedprice"))
    return _tree_rows(spark, ExactTree(TREE_FEATURES, max_depth=2).fit(rows))


@register("exact_class_tree", _TREE_SQL.replace("{label}", "CASE WHEN l_extendedprice > 60000 THEN 1::DOUBLE ELSE 0 END"),
          floats=["threshold", "mean"], ints=["feature", "n"])
def exact_class_tree(spark, sf_dir):
    """K2: the same for a class label (decrease of the Gini impurity)."""
    rows = read_table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_extendedprice") > 60000).cast("double"))
    return _tree_rows(spark, ExactTree(TREE_FEATURES, max_depth=2, classes=True).fit(rows))


@register("grown_forest_fit", """
SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_custkey, o_orderdate::DATE) AS prediction FROM orders""",
          floats=["prediction"], ints=["o_orderkey"])
def grown_forest_fit(spark, sf_dir):
    """Trees without bootstrap, grown to the end, know each point's mean label: upper levels on histograms, the rest in tasks."""
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), F.col("o_totalprice").alias("label"))
    model = GrownForest(["o_custkey", "day"], keys=["o_orderkey"], n_trees=2, sampled=False, hand_over=4000).fit(rows)
    return model.transform(rows).select("o_orderkey", "prediction")


@register("grown_forest_shape")
def grown_forest_shape(spark, sf_dir):
    """K3: what a bootstrap forest of pure leaves looks like: parts, leaves and drawn rows of each tree."""
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    return GrownForest(["o_custkey", "day"], keys=["o_orderkey"], n_trees=5, classes=True, tried="sqrt", hand_over=4000).fit(rows).shape()
