"""The exact kernel machine (K5): its optimum is checked by its own conditions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators.kernel_svm import KernelSVM
from ..sources.readers import read_table
from .catalog import register


@register("svm_optimality", """
SELECT 'rows of class 1' AS condition, count(*) FILTER (WHERE label < 5) AS n, true AS holds FROM embeddings
UNION ALL SELECT 'weights between 0 and C', 0, true
UNION ALL SELECT 'weights of both classes are equal in sum', 0, true
UNION ALL SELECT 'outside the margin, weight above 0', 0, true
UNION ALL SELECT 'inside the margin, weight below C', 0, true""", ints=["n"])
def svm_optimality(spark, sf_dir):
    """K5: how many rows break each condition of the optimum (tolerance 1e-3, margins recomputed from the support vectors)."""
    columns = [f"e{i}" for i in range(12)]
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("label"),
                                                          *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    model = KernelSVM(columns, c=1.0).fit(rows)
    weight = model.vectors.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(columns)], "weight")
    scored = model.transform(rows).join(weight, columns, "left").withColumn("a", F.abs(F.coalesce("weight", F.lit(0.0))))
    m = scored.withColumn("m", vector_to_array("svm_margin")[0] * (2 * F.col("label") - 1))
    one = m.agg(F.count_if(F.col("label") == 1).alias("n"), F.count_if((F.col("a") < 0) | (F.col("a") > 1)).alias("box"),
                F.round(F.abs(F.sum(F.coalesce("weight", F.lit(0.0)))), 6).alias("sum"),
                F.count_if((F.col("m") > 1 + 2e-3) & (F.col("a") > 0)).alias("out"), F.count_if((F.col("m") < 1 - 2e-3) & (F.col("a") < 1)).alias("inside"))
    row = lambda name, n, ok: F.struct(F.lit(name).alias("condition"), n.cast("long").alias("n"), ok.alias("holds"))
    none = lambda name, n: row(name, n, n == 0)
    return one.select(F.inline(F.array(
        row("rows of class 1", F.col("n"), F.lit(True)), none("weights between 0 and C", F.col("box")),
        none("weights of both classes are equal in sum", F.col("sum")), none("outside the margin, weight above 0", F.col("out")),
        none("inside the margin, weight below C", F.col("inside")))))

