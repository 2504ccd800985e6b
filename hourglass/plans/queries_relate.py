"""Correlation / regression-line / collinearity queries (C family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate
from ..sources.readers import read_table
from .catalog import register
from .sweep import gram_sql, swept

CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _lineitem_part(spark, sf_dir):
    """lineitem with its part's retail price and size (equi-join on the part key;
    AQE picks broadcast only when the measured part side is small)."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    return li.join(part, "l_partkey")


@register("corr_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{CORR_COLS[i]}' AS x, '{CORR_COLS[j]}' AS y, corr({CORR_COLS[i]}, {CORR_COLS[j]}) AS r FROM lineitem"
    for i in range(len(CORR_COLS)) for j in range(len(CORR_COLS)) if i > j), floats=["r"])
def corr_lineitem(spark, sf_dir):
    """Pearson matrix, lower triangle in long form, one pass."""
    return relate.corr_long(read_table(spark, sf_dir, "lineitem"), CORR_COLS)


@register("corr_matrix_full", "\nUNION ALL\n".join(
    [f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem"
     for a in CORR_COLS for b in CORR_COLS if a != b]
    + [f"SELECT '{a}' AS x, '{a}' AS y, 1.0 AS r" for a in CORR_COLS]), floats=["r"])
def corr_matrix_full(spark, sf_dir):
    """Symmetric matrix with unit diagonal (long form)."""
    return relate.corr_long(read_table(spark, sf_dir, "lineitem"), CORR_COLS, full=True)


@register("corr_target_rank", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, abs(corr({c}, l_extendedprice)) AS abs_r "
    f"FROM lineitem" for c in CORR_COLS if c != "l_extendedprice"), floats=["r", "abs_r"])
def corr_target_rank(spark, sf_dir):
    """Correlation with the target, ranked by |r| (order by abs_r desc)."""
    return relate.corr_with_target(read_table(spark, sf_dir, "lineitem"), CORR_COLS,
                                   "l_extendedprice").orderBy(F.desc("abs_r"), "feature")


_RECT_ROWS = ("l_discount", "l_tax", "p_retailprice")
_RECT_COLS = ("l_quantity", "l_extendedprice")
_JOIN_SQL = "(SELECT l.*, p.p_retailprice, p.p_size FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"


@register("corr_rect", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS row, '{b}' AS col, corr({a}, {b}) AS r FROM {_JOIN_SQL}"
    for a in _RECT_ROWS for b in _RECT_COLS), floats=["r"])
def corr_rect(spark, sf_dir):
    """C4: covariates x targets correlation block (after a lineitem-part join)."""
    return relate.corr_rect(_lineitem_part(spark, sf_dir), _RECT_ROWS, _RECT_COLS)


_PAIRS = (("l_quantity", "l_extendedprice"), ("p_retailprice", "l_extendedprice"),
          ("l_discount", "l_tax"))


def _pair_sql(keys=()):
    kc = (", ".join(keys) + ", ") if keys else ""
    grp = (" GROUP BY " + ", ".join(keys)) if keys else ""
    return "\nUNION ALL\n".join(
        f"SELECT {kc}'{x}' AS x, '{y}' AS y, regr_count({y}, {x}) AS n, "
        f"CASE WHEN regr_count({y}, {x}) > 10 THEN corr({x}, {y}) END AS r, "
        f"CASE WHEN abs(corr({x}, {y})) > 0.6 THEN 1 ELSE 0 END AS strong, "
        f"regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2 "
        f"FROM {_JOIN_SQL}{grp}" for x, y in _PAIRS)


@register("pair_trends", _pair_sql(), floats=["r", "slope", "intercept", "r2"], ints=["n", "strong"])
def pair_trends(spark, sf_dir):
    """R (n > 10 guard), OLS slope/intercept/R^2 for each pair."""
    return relate.pair_stats(_lineitem_part(spark, sf_dir), _PAIRS)


@register("pair_trends_by_flag", _pair_sql(["l_returnflag"]),
          floats=["r", "slope", "intercept", "r2"], ints=["n", "strong"])
def pair_trends_by_flag(spark, sf_dir):
    """One fit per group (the coloured-scatter trend lines)."""
    return relate.pair_stats(_lineitem_part(spark, sf_dir), _PAIRS, keys=["l_returnflag"])


@register("trend_line", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
                  regr_intercept(l_extendedprice, l_quantity) AS intercept,
                  min(l_quantity) FILTER (WHERE l_extendedprice IS NOT NULL) AS lo,
                  max(l_quantity) FILTER (WHERE l_extendedprice IS NOT NULL) AS hi FROM lineitem)
SELECT CAST(range AS INTEGER) AS i, lo + (hi - lo) * range / CAST(199 AS DOUBLE) AS x,
       slope * (lo + (hi - lo) * range / CAST(199 AS DOUBLE)) + intercept AS y_fit
FROM f, range(200)""", floats=["x", "y_fit"], ints=["i"])
def trend_line(spark, sf_dir):
    """The 200-point fitted line over the observed x range."""
    return relate.trend_line(read_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@register("redundancy_check", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r, "
    f"CASE WHEN abs(corr({x}, {y})) > 0.8 THEN 1 ELSE 0 END AS redundant FROM {_JOIN_SQL}"
    for x, y in _PAIRS), floats=["r"], ints=["redundant"])
def redundancy_check(spark, sf_dir):
    """Row-wise r of paired columns, |r| > 0.8 flagged."""
    return relate.redundancy(_lineitem_part(spark, sf_dir), _PAIRS)


_VIF_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice", "p_size")


def _vif_sql(centred):
    k = len(_VIF_COLS)
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(_VIF_COLS))
    return f"""
WITH d AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _VIF_COLS)} FROM {_JOIN_SQL}),
g AS ({gram_sql(_VIF_COLS, 'd', centred)}),
{swept('g', k)},
v AS (SELECT g.i, -g.v * w{k}.v AS vif FROM g JOIN w{k} USING (i, j) WHERE g.i = g.j)
SELECT feature, vif, CASE WHEN vif > 10 THEN 'High (>10)' WHEN vif > 5 THEN 'Medium (5-10)' ELSE 'Low (<5)' END AS risk
FROM v JOIN (VALUES {names}) AS n(i, feature) USING (i)"""


@register("vif_uncentered", _vif_sql(False), floats=["vif"])
def vif_uncentered(spark, sf_dir):
    """C11: VIF without intercept (dashboard definition), risk bands."""
    return relate.vif(_lineitem_part(spark, sf_dir), _VIF_COLS).orderBy(F.desc("vif"))


@register("vif_centered", _vif_sql(True), floats=["vif"])
def vif_centered(spark, sf_dir):
    """C11 option: classical (centred) VIF from the inverse correlation matrix."""
    return relate.vif(_lineitem_part(spark, sf_dir), _VIF_COLS, centered=True).orderBy(F.desc("vif"))


@register("scatter_bins", """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d),
g AS (SELECT x, y, x0, x1, y0, y1,
             least(greatest(CAST(floor((x - x0) * (CAST(50 AS DOUBLE) / (x1 - x0))) AS INTEGER), 0), 49) AS gx,
             least(greatest(CAST(floor((y - y0) * (CAST(50 AS DOUBLE) / (y1 - y0))) AS INTEGER), 0), 49) AS gy
      FROM d, s),
b AS (SELECT CASE WHEN x1 = x0 THEN 0 WHEN x < x0 + gx * ((x1 - x0) / CAST(50 AS DOUBLE)) THEN gx - 1
                  WHEN x >= x0 + (gx + 1) * ((x1 - x0) / CAST(50 AS DOUBLE)) AND gx <> 49 THEN gx + 1 ELSE gx END AS bin_x,
             CASE WHEN y1 = y0 THEN 0 WHEN y < y0 + gy * ((y1 - y0) / CAST(50 AS DOUBLE)) THEN gy - 1
                  WHEN y >= y0 + (gy + 1) * ((y1 - y0) / CAST(50 AS DOUBLE)) AND gy <> 49 THEN gy + 1 ELSE gy END AS bin_y
      FROM g)
SELECT bin_x, bin_y, count(*) AS count FROM b GROUP BY bin_x, bin_y""", ints=["bin_x", "bin_y", "count"])
def scatter_bins(spark, sf_dir):
    """Scatter data as 50 x 50 bin counts (never the raw points)."""
    from ..operators.profile import scatter_bins as bins2d
    return bins2d(read_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 50)
