"""Correlation, trend lines and collinearity.

All pairwise statistics of a column set come from one aggregation pass
(``corr``/``regr_*`` are pairwise-complete on NULLs, like pandas).  VIF needs
the k x k Gram matrix only: one pass of ``sum(a*b)``, then a k x k inverse on
the driver (k is the number of columns, not rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import STRONG_R, VIF_BANDS, VIF_ELSE, bucket_label, col_of, exceeds


def corr_long(df: DataFrame, cols: Sequence[str], full: bool = False) -> DataFrame:
    """Pearson r of every pair (x, y).

    ``full=False`` returns the lower triangle (pairs i > j, diagonal masked);
    ``full=True`` the whole symmetric matrix with a unit diagonal.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i > j]
    one = df.agg(*[F.corr(col_of(cols[i]).cast("double"), col_of(cols[j]).cast("double")).alias(f"r{i}_{j}")
                   for i, j in pairs])
    rows = [F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), F.col(f"r{i}_{j}").alias("r"))
            for i, j in pairs]
    if full:
        rows += [F.struct(F.lit(cols[j]).alias("x"), F.lit(cols[i]).alias("y"), F.col(f"r{i}_{j}").alias("r"))
                 for i, j in pairs]
        rows += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C1 as a square table: one row per column, one column per column."""
    long = corr_long(df, cols, full=True)
    return long.groupBy("x").pivot("y", list(cols)).agg(F.first("r"))


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """R of every column with the target, ranked by |r| (self dropped)."""
    others = [c for c in cols if c != target]
    one = df.agg(*[F.corr(col_of(c).cast("double"), col_of(target).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(others)])
    long = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(others)])))
    return long.select("feature", "r", F.abs("r").alias("abs_r"))


def corr_rect(df: DataFrame, rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """C4: rectangular correlation (rows x cols) in long form: row, col, r."""
    one = df.agg(*[F.corr(col_of(a).cast("double"), col_of(b).cast("double")).alias(f"r{i}_{j}")
                   for i, a in enumerate(rows) for j, b in enumerate(cols)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"r{i}_{j}").alias("r"))
        for i, a in enumerate(rows) for j, b in enumerate(cols)])))


def pair_stats(df: DataFrame, pairs: Sequence[tuple[str, str]], min_n: int = 10,
               keys: Sequence[str] = ()) -> DataFrame:
    """Per (x, y) pair and key: n, r (only when n > min_n), P10's flag of a strong r,
    OLS slope, intercept and R^2 of y on x."""
    aggs = []
    for k, (x, y) in enumerate(pairs):
        xv, yv = col_of(x).cast("double"), col_of(y).cast("double")
        aggs += [F.regr_count(yv, xv).alias(f"n{k}"), F.corr(xv, yv).alias(f"r{k}"),
                 F.regr_slope(yv, xv).alias(f"s{k}"), F.regr_intercept(yv, xv).alias(f"i{k}"),
                 F.regr_r2(yv, xv).alias(f"q{k}")]
    one = df.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{k}").alias("n"),
                     F.when(F.col(f"n{k}") > min_n, F.col(f"r{k}")).alias("r"),
                     F.when(F.col(f"n{k}") > min_n, exceeds(F.col(f"r{k}"), STRONG_R)).alias("strong"),
                     F.col(f"s{k}").alias("slope"), F.col(f"i{k}").alias("intercept"),
                     F.col(f"q{k}").alias("r2"))
            for k, (x, y) in enumerate(pairs)]
    return one.select(*keys, F.inline(F.array(*rows)))


def redundancy(df: DataFrame, pairs: Sequence[tuple[str, str]], threshold: float = 0.8) -> DataFrame:
    """R of sensor/reference pairs on complete rows, flag |r| > threshold."""
    st = pair_stats(df, pairs, min_n=0)
    return st.select("x", "y", "r", (F.abs("r") > threshold).cast("int").alias("redundant"))


def trend_line(df: DataFrame, x: str, y: str, points: int = 200, keys: Sequence[str] = ()) -> DataFrame:
    """Degree-1 least-squares line evaluated at ``points`` evenly spaced x
    values between min(x) and max(x) (per key)."""
    xv, yv = col_of(x).cast("double"), col_of(y).cast("double")
    both = xv.isNotNull() & yv.isNotNull()
    fit = df.groupBy(*keys).agg(F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
                                F.min(F.when(both, xv)).alias("lo"), F.max(F.when(both, xv)).alias("hi"))
    grid = fit.select(*keys, "slope", "intercept", "lo", "hi",
                      F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xs = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    return grid.select(*keys, "i", xs.alias("x"), (F.col("slope") * xs + F.col("intercept")).alias("y_fit"))


def gram(df: DataFrame, cols: Sequence[str], centered: bool = False) -> tuple[np.ndarray, int]:
    """k x k matrix of sum(a*b) over complete rows (one pass)."""
    cols = list(cols)
    complete = df.select([col_of(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).dropna()
    k = len(cols)
    if centered:
        aggs = [F.count(F.lit(1)).alias("n")] + [
            F.covar_pop(f"v{i}", f"v{j}").alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    else:
        aggs = [F.count(F.lit(1)).alias("n")] + [
            F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = complete.agg(*aggs).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, int(row["n"])


def _inflation(g: np.ndarray, i: int, tolerance: float = 1e-10) -> float | None:
    """Total over residual sum of squares of column ``i`` regressed on the others."""
    d = np.sqrt(np.diag(g))
    if not d[i] > 0:
        return None
    others = [j for j in range(len(g)) if j != i and d[j] > 0]
    if not others:
        return 1.0
    r = g / np.outer(np.where(d > 0, d, 1.0), np.where(d > 0, d, 1.0))      # unit diagonal: rank does not hang on units
    beta = np.linalg.lstsq(r[np.ix_(others, others)], r[others, i], rcond=1e-12)[0]
    rest = 1.0 - float(beta @ r[others, i])
    return 1.0 / rest if rest > tolerance else math.inf


def vif(df: DataFrame, cols: Sequence[str], centered: bool = False) -> DataFrame:
    """C11: variance inflation factor of each column on complete rows.

    ``centered=False`` (dashboard default): each column regressed on the
    others without an intercept, VIF_i = G_ii * (G^-1)_ii with G = X'X.
    ``centered=True``: classical VIF from the inverse correlation matrix.
    A column that the others reproduce has an infinite VIF; one without any
    variation (or, uncentred, all zero) has none (NULL).
    """
    cols = list(cols)
    g, n = gram(df, cols, centered)
    values = [_inflation(g, i) for i in range(len(cols))]
    out = df.sparkSession.createDataFrame([(c, v) for c, v in zip(cols, values)], "feature string, vif double")
    return out.select("feature", "vif", F.when(F.col("vif").isNotNull(), bucket_label("vif", VIF_BANDS, VIF_ELSE)).alias("risk"))
