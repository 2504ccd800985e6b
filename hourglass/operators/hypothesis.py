"""Statistical tests (H1-H7).

Group comparisons reduce each group to (n, mean, variance) in one pass; the
test statistic is column math on that one row per key, and only the p-value
(a special function Spark lacks) goes through a pandas UDF on those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import lilliefors_p_col, norm_cdf_col, norm_ppf_col, shapiro_wilk, t_pvalue_col
from ..functions.scalar import EFFECT_BANDS, EFFECT_ELSE, bucket_label, col_of, ratio, skew_shape
from ..session import cut_lineage, materialise
from .linear import row_ranks


def group_moments(df: DataFrame, value: str, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """H1: split by flag (0 -> A, 1 -> B) and reduce each side to n, mean, var."""
    x, f = col_of(value).cast("double"), col_of(flag)
    a, b = F.when(f == 0, x), F.when(f == 1, x)
    return df.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"))


def welch_effect(df: DataFrame, value: str, flag: str, keys: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """H2-H4 without the p-value: Welch t (sign A-B), Welch-Satterthwaite df,
    Cohen's d (B-A over the root mean variance) and the CI of B-A."""
    m = group_moments(df, value, flag, keys)
    va, vb = ratio(F.col("var_a"), F.col("n_a")), ratio(F.col("var_b"), F.col("n_b"))
    se = F.sqrt(va + vb)
    diff = F.col("mean_b") - F.col("mean_a")
    dof = ratio((va + vb) ** 2, ratio(va ** 2, F.col("n_a") - 1) + ratio(vb ** 2, F.col("n_b") - 1))
    return m.select(
        *keys, F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"),
        "mean_a", "mean_b", ratio(F.col("mean_a") - F.col("mean_b"), se).alias("t_stat"), dof.alias("dof"),
        ratio(diff, F.sqrt((F.col("var_a") + F.col("var_b")) / 2)).alias("cohens_d"),
        diff.alias("diff"), (diff - z * se).alias("ci_lo"), (diff + z * se).alias("ci_hi"))


def welch_test(df: DataFrame, value: str, flag: str, keys: Sequence[str] = (),
               alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    """H2-H5: Welch test with p-value, effect label and decision per key.

    ``alternative`` is about A - B: "two-sided", "less" (A < B, i.e. B higher)
    or "greater".
    """
    eff = welch_effect(df, value, flag, keys)
    p = t_pvalue_col(F.col("t_stat"), F.col("dof"), alternative)
    return eff.withColumn("p_value", p).withColumns({
        "significant": (F.col("p_value") < alpha).cast("int"),
        "effect_size": bucket_label("cohens_d", EFFECT_BANDS, EFFECT_ELSE, absolute=True),
        "uplift_pct": ratio(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100.0,
    })


def decision_table(test: DataFrame, label_a: str = "Off-peak", label_b: str = "Rush hour") -> DataFrame:
    """H5: the test result as (metric, result) text rows."""
    fmt = lambda spec, c: F.format_string(spec, F.col(c))
    rows = [
        ("method", F.lit("welch_t")),
        ("null_hypothesis", F.lit(f"mean({label_b}) = mean({label_a})")),
        ("alternative", F.lit(f"mean({label_b}) <> mean({label_a})")),
        ("t_stat", fmt("%.4f", "t_stat")),
        ("p_value", fmt("%.6f", "p_value")),
        ("significant_at_5_pct", F.when(F.col("significant") == 1, F.lit("yes")).otherwise(F.lit("no"))),
        ("cohens_d", fmt("%.4f", "cohens_d")),
        ("effect_size", F.col("effect_size")),
        ("difference_ci_95", F.format_string("[%.4f, %.4f]", F.col("ci_lo"), F.col("ci_hi"))),
        ("decision", F.when(F.col("significant") == 1, F.lit("null_rejected")).otherwise(F.lit("null_kept"))),
    ]
    return test.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("metric"), v.alias("result"))
        for i, (k, v) in enumerate(rows)])))


# ---------------------------------------------------------------- normality
def jarque_bera(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full-data normality companion: JB = n/6 (g1^2 + g2^2/4), p = exp(-JB/2)."""
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}")]
    one = df.agg(*aggs)
    long = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("g1"),
                 F.col(f"k{i}").alias("g2")) for i, c in enumerate(cols)])))
    jb = F.col("n") / 6.0 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4.0)
    return long.select("column", F.col("n").cast("bigint").alias("n"), "g1", "g2", jb.alias("jb"),
                       F.exp(-jb / 2.0).alias("p_value"),
                       (F.exp(-jb / 2.0) > 0.05).cast("int").alias("normal"))


def lilliefors_test(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """H6 on whole columns: the largest distance between a column's distribution and the normal of its own mean and deviation, with
    its p-value: ``column, n, mean, std, d, p_value, normal``.

    All columns are ranked together over sorted ranges (``row_ranks``); each row then knows both sides of its step, and the distance
    is a maximum, so no column is gathered anywhere.  NULL and NaN do not count; a constant column has no distance."""
    x = lambda c: F.nanvl(col_of(c).cast("double"), F.lit(None))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), x(c).alias("x")) for i, c in enumerate(cols)]))).where(F.col("x").isNotNull())
    ranked = row_ranks(long, ["c", "x"], "i")
    moments = long.groupBy("c").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))      # a row a column
    one = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    moments = materialise(moments.withColumn("start", F.coalesce(F.sum("n").over(one), F.lit(0))))
    cdf = norm_cdf_col((F.col("x") - F.col("mean")) / F.col("std"))
    at = F.col("i") - F.col("start")
    step = F.when(F.col("std") > 0, F.greatest((at + 1) / F.col("n") - F.col("cdf"), F.col("cdf") - at / F.col("n")))
    far = ranked.join(F.broadcast(moments), "c").withColumn("cdf", cdf).groupBy("c").agg(F.max(step).alias("d"))
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    out = moments.join(far, "c").withColumn("p_value", lilliefors_p_col(F.col("d"), F.col("n")))
    return out.select(names.alias("column"), "n", "mean", "std", "d", "p_value", (F.col("p_value") > alpha).cast("int").alias("normal"))


def hash_sample(df: DataFrame, cols: Sequence[str], size: int = 500, seed: int = 42) -> DataFrame:
    """Deterministic sample of ``size`` non-NULL values per column: the rows
    with the smallest seeded hash.  A hash-threshold filter first keeps about
    4 x size rows per column (exact: every row below the threshold is kept,
    and the threshold is raised if fewer than ``size`` pass), so the final
    per-column ranking only sees a bounded set."""
    cols = list(cols)
    row_cols = [col_of(c) for c in df.columns]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast("double").alias("x"),
                 F.xxhash64(F.lit(seed), F.lit(c), *row_cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("h"))
        for c in cols]))).filter(F.col("x").isNotNull())
    one = df.agg(*[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = {c: one[f"n{i}"] for i, c in enumerate(cols)}
    frac = {c: min(1.0, 4.0 * size / max(counts.get(c, 0), 1)) for c in cols}
    spark = df.sparkSession
    while True:
        cond = None
        for c in cols:
            thr = F.lit(int(frac[c] * float(0x7FFFFFFFFFFFFFFF)) if frac[c] < 1.0 else 0x7FFFFFFFFFFFFFFF)
            term = (F.col("column") == c) & (F.col("h") <= thr)
            cond = term if cond is None else cond | term
        # about 4 x size rows per column survive: materialise them once
        kept = long.filter(cond)
        kept = materialise(kept)
        got = {r["column"]: r["n"] for r in kept.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [c for c in cols if got.get(c, 0) < min(size, counts.get(c, 0)) and frac[c] < 1.0]
        if not short:
            break
        for c in short:
            frac[c] = min(1.0, frac[c] * 4)
    w = Window.partitionBy("column").orderBy("h", "x")
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r", "h")


def shapiro_test(df: DataFrame, cols: Sequence[str], size: int = 500, seed: int = 42) -> DataFrame:
    """H6: Shapiro-Wilk on a deterministic <= size sample per column, plus the
    whole-column skewness and shape label."""
    sample = hash_sample(df, cols, size, seed)

    def sw(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["x"].to_numpy())
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n_sample": [len(pdf)],
                             "w_stat": [w], "p_value": [p]})

    res = sample.groupBy("column").applyInPandas(sw, "column string, n_sample long, w_stat double, p_value double")
    from .profile import skewness
    sk = skewness(df, cols).select("column", "skew")
    return res.join(sk, "column").select(
        "column", "n_sample", "w_stat", "p_value", (F.col("p_value") > 0.05).cast("int").alias("normal"),
        "skew", skew_shape("skew").alias("shape"))


# ---------------------------------------------------------------- QQ
def qq_points(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """H7: normal probability plot data: (i, sample quantile, theoretical quantile).

    Ranks are computed without a single-task window: rows are range
    partitioned on (x, row number) -- the number spreads a heavily repeated value
    over several partitions, and no other column is read -- and sorted within partitions; a row's rank is
    its position in the partition plus the row count of all earlier
    partitions (one small count per partition).  Theoretical quantiles are
    Filliben's order-statistic medians through the inverse normal CDF.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = col_of(col).cast("double")
    data = df.select(x.alias("x"), F.monotonically_increasing_id().alias("_h")) \
             .filter(F.col("x").isNotNull())
    ranged = (data.repartitionByRange(partitions, "x", "_h").sortWithinPartitions("x", "_h")
                  .withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"pid": F.shiftright("_id", 33),
                                 "local": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    # written once: ranks and counts must see the same partitions, and range bounds are sampled per run
    ranged = cut_lineage(ranged)
    per_part = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"))
    offsets = per_part.select(
        "pid", (F.sum("cnt").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).alias("off"),
        F.sum("cnt").over(Window.partitionBy()).alias("n"))
    # one row per partition: bounded by the partition count, never by the data
    ranked = ranged.join(F.broadcast(offsets), "pid").select(
        (F.coalesce(F.col("off"), F.lit(0)) + F.col("local") + 1).alias("i"), "x", "n")
    n = F.col("n").cast("double")
    m_n = F.pow(F.lit(0.5), 1.0 / n)
    v = (F.when(F.col("i") == F.col("n"), m_n).when(F.col("i") == 1, 1.0 - m_n)
         .otherwise((F.col("i") - 0.3175) / (n + 0.365)))
    return ranked.select(F.col("i").cast("bigint").alias("i"), F.col("x").alias("osr"),
                         norm_ppf_col(v).alias("osm"))


def qq_fit(points: DataFrame) -> DataFrame:
    """H7 line: least squares of sample on theoretical quantiles, and r."""
    return points.agg(F.regr_slope("osr", "osm").alias("slope"),
                      F.regr_intercept("osr", "osm").alias("intercept"),
                      F.corr("osr", "osm").alias("r"))


def qq_grid(df: DataFrame, col: str, points: int = 1000, accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """H7 for very large n: ``points`` probability-plot points instead of n.

    Theoretical quantiles at p_j = (j - 0.5) / points; sample quantiles from
    one fixed-size sketch pass (rank error at most n / accuracy), or, ``exact``, the values of
    the ranks ceil(p_j n) from sorted ranges."""
    if exact:
        ranked = row_ranks(df.select(F.nanvl(col_of(col).cast("double"), F.lit(None)).alias("osr")).where(F.col("osr").isNotNull()), ["osr"])
        n = ranked.count()
        # a row's points: those j with ceil((2 j - 1) n / (2 points)) = rank + 1, in whole numbers
        first = F.floor((2 * points * F.col("rank") + n) / (2 * n)).cast("long")
        last = F.floor((2 * points * (F.col("rank") + 1) + n) / (2 * n)).cast("long")
        some = ranked.where(last > first).select("osr", F.explode(F.sequence(first + 1, last)).alias("i")) if n else \
            ranked.select("osr", F.col("rank").alias("i"))
        p = (F.col("i") - 0.5) / points
        return some.select("i", p.alias("p"), "osr", norm_ppf_col(p).alias("osm"))
    probs = [(j - 0.5) / points for j in range(1, points + 1)]
    q = df.agg(F.percentile_approx(col_of(col).cast("double"), probs, accuracy).alias("q"))
    pts = q.select(F.posexplode("q").alias("j", "osr"))
    p = (F.col("j") + 0.5) / points
    return pts.select((F.col("j") + 1).cast("bigint").alias("i"), p.alias("p"), "osr", norm_ppf_col(p).alias("osm"))
