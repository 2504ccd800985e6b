"""Nearest-neighbour classification queries (K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.neighbours import nearest_neighbours, vote
from ..sources.readers import read_table
from .catalog import register

_VOTE_SQL = """,
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY distance, id) AS rank FROM d) WHERE rank <= 7),
v AS (SELECT {keys}, label, count(*) AS v, min(distance) AS near, max(distance) AS far FROM r GROUP BY ALL)
SELECT {keys}, arg_max(label, 100 * v - label) AS prediction, max(v) / sum(v) AS confidence, min(near) AS nearest, max(far) AS farthest
FROM v GROUP BY {keys}"""


@register("knn_embeddings", """
WITH d AS (SELECT a.vec_id, p.vec_id AS id, p.label, list_distance(a.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS distance
           FROM embeddings a JOIN embeddings p ON a.vec_id % 5 = 0 AND p.vec_id % 5 <> 0)""" + _VOTE_SQL.format(keys="vec_id"),
          floats=["prediction", "confidence", "nearest", "farthest"], ints=["vec_id"])
def knn_embeddings(spark, sf_dir):
    """K6: label of every fifth vector by vote of its 7 nearest among the others (64 dimensions)."""
    rows = read_table(spark, sf_dir, "embeddings")
    near, _ = nearest_neighbours(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0").select("vec_id", "embedding"),
                                 "embedding", "vec_id", "label")
    return vote(near, ["vec_id"])


@register("knn_price_class", """
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount, CASE WHEN l_extendedprice > 35000 THEN 1.0 ELSE 0.0 END AS label,
                  row_number() OVER (PARTITION BY l_quantity, l_discount ORDER BY l_orderkey * 10 + l_linenumber) AS copy
           FROM lineitem WHERE l_orderkey % 10 <> 0),
a AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem WHERE l_orderkey % 10 = 0),
d AS (SELECT a.l_quantity, a.l_discount, id, label,
             sqrt((t.l_quantity / 50.0 - a.l_quantity / 50.0) ** 2 + (t.l_discount * 10.0 - a.l_discount * 10.0) ** 2) AS distance
      FROM a, t WHERE copy <= 7)""" + _VOTE_SQL.format(keys="l_quantity, l_discount"),
          floats=["l_quantity", "l_discount", "prediction", "confidence", "nearest", "farthest"])
def knn_price_class(spark, sf_dir):
    """K6 on a plane full of equal points and ties: the price class by quantity and discount."""
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0).alias("x")
    li = read_table(spark, sf_dir, "lineitem")
    train = li.where("l_orderkey % 10 <> 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x,
                                                    (F.col("l_extendedprice") > 35000).cast("double").alias("label"))
    asked = li.where("l_orderkey % 10 = 0").select("l_quantity", "l_discount").distinct().select("l_quantity", "l_discount", x)
    near, _ = nearest_neighbours(train, asked, "x", "id", "label")
    return vote(near, ["l_quantity", "l_discount"])


@register("knn_work")
def knn_work(spark, sf_dir):
    """K6: what the pivot cells save: points met per asked vector, against all there are."""
    rows = read_table(spark, sf_dir, "embeddings")
    train = rows.where("vec_id % 5 <> 0").select("vec_id", "label", F.slice("embedding", 1, 3).alias("x"))
    asked = rows.where("vec_id % 5 = 0").select("vec_id", F.slice("embedding", 1, 3).alias("x"))
    _, work = nearest_neighbours(train, asked, "x", "vec_id", "label")
    return work.agg(F.count(F.lit(1)).alias("asked"), F.avg("n_cells").alias("cells"), F.sum("n_compared").alias("compared"),
                    F.lit(train.count()).alias("points"))
