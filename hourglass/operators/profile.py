"""Profiling: missingness, describe, skewness, histograms, box plots,
group means, value counts and uplift (M2-M4, A1-A14).

Rule: every operator scans its input once for all columns (one ``agg``), then
reshapes the single result row with ``stack``; per-group variants aggregate
per key and never collect rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import STRONG_SKEW, col_of, exceeds, ratio
from .clean import numeric_columns
from .joins import key_join, measured
from .quantiles import grouped_quantiles, quantiles
from ..session import materialise


def _unpivot(one_row: DataFrame, labels: list[str], fields: list[str], key: str = "column") -> DataFrame:
    """Turn columns named ``{i}__{field}`` of a one-row frame into a long frame."""
    n = len(labels)
    parts = []
    for i, label in enumerate(labels):
        parts.append(F.lit(label))
        parts.extend(F.col(f"c{i}__{f}") for f in fields)
    expr = F.inline(F.array(*[
        F.struct(*([parts[i * (len(fields) + 1)].alias(key)]
                   + [parts[i * (len(fields) + 1) + 1 + j].alias(f) for j, f in enumerate(fields)]))
        for i in range(n)]))
    return one_row.select(expr)


# ---------------------------------------------------------------- missingness
def missing_profile(df: DataFrame, cols: Sequence[str] | None = None,
                    drop_above: float = 50.0) -> DataFrame:
    """M2/M4: per column: missing count, missing % (1 dp), action by rule."""
    cols = list(cols) if cols is not None else df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(col_of(c).isNull()).alias(f"c{i}__missing") for i, c in enumerate(cols)])
    long = _unpivot(one.select("*", *[F.col("n").alias(f"c{i}__n") for i in range(len(cols))]),
                    cols, ["missing", "n"])
    share = ratio(F.col("missing") * 100.0, F.col("n"))
    pct = F.bround(share, 1)
    return long.select(
        "column",
        F.col("missing").cast("bigint").alias("missing"),
        F.col("n").cast("bigint").alias("rows"),
        pct.alias("missing_pct"),
        F.when(share > drop_above, F.lit("drop"))
         .when(F.col("missing") > 0, F.lit("impute_median"))
         .otherwise(F.lit("none")).alias("action"),
        F.coalesce((share > drop_above).cast("int"), F.lit(0)).alias("over_threshold"),
    )


def overall_missing_pct(profile: DataFrame) -> DataFrame:
    """M3: mean over columns of the (unrounded) missing share, in % to 1 dp."""
    return profile.agg(F.bround(F.avg(ratio(F.col("missing") * 100.0, F.col("rows"))), 1)
                       .alias("overall_missing_pct"))


def sparse_columns(df: DataFrame, threshold: float = 50.0, cols: Sequence[str] | None = None) -> list[str]:
    """P2 generalised: columns whose missing share is above ``threshold`` percent."""
    prof = missing_profile(df, cols, threshold).filter("over_threshold = 1").select("column")
    return [r[0] for r in prof.collect()]  # one name per column: bounded by the schema


# ---------------------------------------------------------------- shape / types
def shape_kpis(df: DataFrame, ts: str | None = None, sensor_marker: str = "PT08") -> DataFrame:
    """A1: rows, columns, sensor columns, observed period."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("rows")]
    if ts:
        aggs += [F.min(ts).alias("period_start"), F.max(ts).alias("period_end")]
    return df.agg(*aggs).select(
        "*", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(sum(sensor_marker in c for c in df.columns)).cast("bigint").alias("sensor_columns"))


def type_profile(df: DataFrame) -> DataFrame:
    """A2: name, type, nulls, null %."""
    prof = missing_profile(df)
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string")
    return types.join(prof, "column").select("column", "dtype", F.col("missing").alias("nulls"),
                                             F.col("missing_pct").alias("null_pct"))


# ---------------------------------------------------------------- describe
def describe(df: DataFrame, cols: Sequence[str] | None = None, method: str = "select") -> DataFrame:
    """A3: count, mean, std (n-1), min, 25/50/75 %, max per column (long form).

    ``method``: "select" (default) computes count/mean/std/min/max in one
    pass and the quartiles by bounded-memory exact selection (a few more
    passes, any table size); "exact" computes everything in one pass with
    Spark's ``percentile`` (buffer grows with distinct values); "approx" uses
    a fixed-size sketch in the same single pass.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    probs = [0.25, 0.5, 0.75]
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}__count"), F.avg(x).alias(f"c{i}__mean"),
                 F.stddev_samp(x).alias(f"c{i}__std"), F.min(x).alias(f"c{i}__min"),
                 F.max(x).alias(f"c{i}__max")]
        if method == "approx":
            aggs.append(F.percentile_approx(x, probs, 10_000).cast("array<double>").alias(f"c{i}__q"))
        elif method == "exact":
            aggs.append(F.percentile(x, F.array(*[F.lit(p) for p in probs])).alias(f"c{i}__q"))
    if method == "select":
        # the moments ride along with the quantile sketch pass: two scans in all
        got: dict = {}
        qs = quantiles(df, cols, probs, "select", extra=aggs, extra_out=got)
        spark = df.sparkSession
        one = spark.range(1).select(
            *[F.lit(got[a]).cast("double" if not a.endswith("__count") else "bigint").alias(a)
              for a in [f"c{i}__{f}" for i in range(len(cols)) for f in ("count", "mean", "std", "min", "max")]],
            *[F.array(*[F.lit(v).cast("double") for v in qs[c]]).alias(f"c{i}__q") for i, c in enumerate(cols)])
    else:
        one = df.agg(*aggs)
    long = _unpivot(one, cols, ["count", "mean", "std", "min", "q", "max"])
    return long.select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
                       F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
                       F.col("q")[2].alias("q75"), "max")


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: bias-adjusted sample skewness G1 (pandas ``skew``) per column, and P10's flag of a strong one."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}__n"), F.skewness(x).alias(f"c{i}__g1")]
    long = _unpivot(df.agg(*aggs), cols, ["n", "g1"])
    n = F.col("n").cast("double")
    adj = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    strong = exceeds("skew", STRONG_SKEW)
    return long.select("column", F.col("n").cast("bigint").alias("n"), adj.alias("skew")).withColumn("strong", strong)


def moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, mean, population skewness g1 and excess kurtosis g2 per column (one pass)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}__n"), F.avg(x).alias(f"c{i}__mean"),
                 F.skewness(x).alias(f"c{i}__g1"), F.kurtosis(x).alias(f"c{i}__g2")]
    return _unpivot(df.agg(*aggs), cols, ["n", "mean", "g1", "g2"])


# ---------------------------------------------------------------- histograms
def _bin_index(x, lo, hi, bins: int):
    """numpy ``histogram`` bin of x for equal-width edges lo..hi (last bin closed).

    The first guess ``floor((x-lo) * bins / (hi-lo))`` is corrected against the
    edges ``lo + i*(hi-lo)/bins`` exactly as numpy does.
    """
    width = (hi - lo) / F.lit(float(bins))
    guess = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    edge = lambda k: lo + k.cast("double") * width
    fixed = (F.when(x < edge(guess), guess - 1)
             .when((x >= edge(guess + 1)) & (guess != bins - 1), guess + 1)
             .otherwise(guess))
    return F.when(hi == lo, F.lit(0)).otherwise(fixed)


def histogram(df: DataFrame, col: str, bins: int = 40, keys: Sequence[str] = (),
              density: bool = False) -> DataFrame:
    """Equal-width histogram, edges from min/max (per key when keyed).

    Output: keys..., bin, lo, hi, count[, density]; empty bins are present.
    The per-key edge table has one row per key; it joins back to the data on
    the key (AQE broadcasts it only when its measured size is small).
    """
    x = col_of(col).cast("double")
    data = df.select(*keys, x.alias("x")).filter(F.col("x").isNotNull())
    # numpy's rule for a constant sample: the range becomes [v - 0.5, v + 0.5]
    flat = F.min("x") == F.max("x")
    stats = data.groupBy(*keys).agg(F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
                                    F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
                                    F.count(F.lit(1)).alias("n"))
    if keys:
        stats = measured(stats)
        binned = key_join(data, stats, keys)
    else:
        row = stats.first()
        if row is None:
            return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count bigint")
        binned = data.select("x", F.lit(row["lo"]).alias("lo"), F.lit(row["hi"]).alias("hi"))
    counts = (binned.select(*keys, _bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    spine = stats.select(*keys, "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = (key_join(spine, counts, [*keys, "bin"], "left")
           .select(*keys, "bin",
                   (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                   F.when(F.col("bin") == bins - 1, F.col("hi"))
                    .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                   "n", width.alias("width")))
    if density:
        out = out.withColumn("density", F.when(F.col("width") > 0,
                                               ratio(F.col("count"), F.col("n") * F.col("width"))))
    return out.drop("n", "width")


# ---------------------------------------------------------------- box plots
def boxplot_stats(df: DataFrame, col: str, keys: Sequence[str] = (), whis: float = 1.5,
                  method: str = "select") -> DataFrame:
    """Quartiles, whiskers at the furthest points within whis*IQR, flier count.

    Quartiles: ``"select"`` (default) is exact with bounded memory, per group
    too (``grouped_quantiles``), so a group holding a large share of the rows
    is fine; ``"exact"`` uses Spark's ``percentile``; ``"approx"`` a sketch.
    Mean, whiskers and fliers then come from one pass joined to the
    one-row-per-group quartiles."""
    keys = list(keys)
    x = col_of(col).cast("double")
    data = df.select(*keys, x.alias("x")).filter(F.col("x").isNotNull())
    probs = [0.25, 0.5, 0.75]
    if not keys:
        qs = quantiles(data, ["x"], probs, "select" if method == "select" else method)["x"]
        if qs[0] is None:
            return df.sparkSession.createDataFrame(
                [], "n bigint, mean double, q1 double, median double, q3 double, whisker_lo double, "
                    "whisker_hi double, fliers bigint")
        q1, med, q3 = qs
        lo, hi = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
        xc = F.col("x")
        return data.agg(
            F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("x").alias("mean"),
            F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
            F.min(F.when(xc >= lo, xc)).alias("whisker_lo"), F.max(F.when(xc <= hi, xc)).alias("whisker_hi"),
            F.count_if((xc < lo) | (xc > hi)).cast("bigint").alias("fliers"))
    if method == "select":
        q = grouped_quantiles(data, keys, "x", probs)
    else:
        qexpr = (F.percentile_approx("x", probs, 10_000).cast("array<double>") if method == "approx"
                 else F.percentile("x", F.array(*[F.lit(p) for p in probs])))
        q = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), qexpr.alias("q"))
    q = q.select(*keys, F.col("n"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumns({"fence_lo": F.col("q1") - whis * (F.col("q3") - F.col("q1")),
                       "fence_hi": F.col("q3") + whis * (F.col("q3") - F.col("q1"))})
    xc = F.col("x")
    out = key_join(data, measured(q), keys).groupBy(*keys, "n", "q1", "median", "q3", "fence_lo", "fence_hi").agg(
        F.avg("x").alias("mean"),
        F.min(F.when(xc >= F.col("fence_lo"), xc)).alias("whisker_lo"),
        F.max(F.when(xc <= F.col("fence_hi"), xc)).alias("whisker_hi"),
        F.count_if((xc < F.col("fence_lo")) | (xc > F.col("fence_hi"))).alias("fliers"))
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), "mean", "q1", "median", "q3",
                      "whisker_lo", "whisker_hi", F.col("fliers").cast("bigint").alias("fliers"))


# ---------------------------------------------------------------- group means etc.
def group_means(df: DataFrame, by: Sequence[str] | str, cols: Sequence[str],
                count_as: str | None = "n", rollup: bool = False) -> DataFrame:
    """Mean of each column per group (hour, weekday, month, season...).

    ``rollup=True`` adds the subtotal levels (grouping sets of the prefixes of
    ``by`` and the grand total) in the same aggregation, with a ``level``
    column counting the rolled-up keys."""
    by = [by] if isinstance(by, str) else list(by)
    aggs = [F.avg(col_of(c)).alias(f"mean_{c}") for c in cols]
    if count_as:
        aggs.append(F.count(F.lit(1)).cast("bigint").alias(count_as))
    if rollup:
        return df.rollup(*by).agg(*aggs, F.grouping_id().cast("bigint").alias("level"))
    return df.groupBy(*by).agg(*aggs)


def distinct_counts(df: DataFrame, cols: Sequence[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct values per column in one pass (``exact=False``: HyperLogLog++)."""
    fn = (lambda c: F.count_distinct(col_of(c))) if exact else (lambda c: F.approx_count_distinct(col_of(c), rsd))
    one = df.agg(*[fn(c).alias(f"c{i}__n_distinct") for i, c in enumerate(cols)])
    long = _unpivot(one, list(cols), ["n_distinct"])
    return long.select("column", F.col("n_distinct").cast("bigint").alias("n_distinct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share (%) per value.

    The per-value counts are materialised once (shared checkpoint folder) and
    the total is one scalar from them, so no window gathers all distinct
    values into one task, whatever the column's cardinality."""
    counts = df.groupBy(col_of(col).alias(col)).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    counts = materialise(counts)
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.select(col, "count", ratio(F.col("count") * 100.0, F.lit(total)).alias("share_pct"))


def uplift(df: DataFrame, flag: str, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of ``col`` where flag=0 (A) and flag=1 (B), uplift % = (B-A)/A*100."""
    x = col_of(col)
    f = col_of(flag)
    out = df.groupBy(*keys).agg(
        F.avg(F.when(f == 0, x)).alias("mean_a"), F.avg(F.when(f == 1, x)).alias("mean_b"),
        F.count_if((f == 0) & x.isNotNull()).cast("bigint").alias("n_a"),
        F.count_if((f == 1) & x.isNotNull()).cast("bigint").alias("n_b"))
    return out.withColumn("uplift_pct", ratio(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100.0)


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   method: str = "select") -> DataFrame:
    """Whole-column quantiles (bounded-memory exact selection by default)."""
    res = quantiles(df, cols, probs, method)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, res[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def data_dictionary(df: DataFrame, roles: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Column, type, role and description; roles come from ``roles`` or
    from each field's metadata (``{"role": ..., "description": ...}``)."""
    roles = roles or {}
    rows = []
    for f in df.schema.fields:
        role, desc = roles.get(f.name, (f.metadata.get("role", "other"), f.metadata.get("description", "")))
        rows.append((f.name, f.dataType.simpleString(), role, desc))
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, role string, description string")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Scatter-plot data as 2-D bin counts over each axis' [min, max]
    (constant-size output instead of collecting points)."""
    xv, yv = col_of(x).cast("double"), col_of(y).cast("double")
    data = df.select(*keys, xv.alias("x"), yv.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    lim = data.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                   F.max("y").alias("y1")).first()
    if lim["x0"] is None:
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, count bigint")
    x0, x1, y0, y1 = (float(lim[k]) for k in ("x0", "x1", "y0", "y1"))
    if x0 == x1:
        x0, x1 = x0 - 0.5, x1 + 0.5
    if y0 == y1:
        y0, y1 = y0 - 0.5, y1 + 0.5
    lx, hx, ly, hy = (F.lit(v) for v in (x0, x1, y0, y1))
    return (data.select(*keys, _bin_index(F.col("x"), lx, hx, bins).alias("bin_x"),
                        _bin_index(F.col("y"), ly, hy, bins).alias("bin_y"))
                .groupBy(*keys, "bin_x", "bin_y").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
