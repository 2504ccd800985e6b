"""Statistical-test queries (H family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import norm_cdf_sql, norm_ppf_sql
from ..operators import hypothesis as hyp
from ..sources.readers import read_table
from .catalog import register
from .fixtures import LINEITEM_NUMERIC, clean_events
from .queries_profile import CLEAN_EVENTS_SQL

_EFFECT_SQL = CLEAN_EVENTS_SQL + """,
m AS (SELECT event_type,
             count(value) FILTER (WHERE is_rush_hour = 0) AS n_a, count(value) FILTER (WHERE is_rush_hour = 1) AS n_b,
             avg(value) FILTER (WHERE is_rush_hour = 0) AS mean_a, avg(value) FILTER (WHERE is_rush_hour = 1) AS mean_b,
             var_samp(value) FILTER (WHERE is_rush_hour = 0) AS var_a,
             var_samp(value) FILTER (WHERE is_rush_hour = 1) AS var_b
      FROM clean GROUP BY event_type)
SELECT event_type, n_a, n_b, mean_a, mean_b,
       (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t_stat,
       power(var_a / n_a + var_b / n_b, 2)
         / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS dof,
       (mean_b - mean_a) / sqrt((var_a + var_b) / 2) AS cohens_d,
       mean_b - mean_a AS diff,
       mean_b - mean_a - 1.96 * sqrt(var_a / n_a + var_b / n_b) AS ci_lo,
       mean_b - mean_a + 1.96 * sqrt(var_a / n_a + var_b / n_b) AS ci_hi
FROM m"""


@register("rush_effect", _EFFECT_SQL,
          floats=["mean_a", "mean_b", "t_stat", "dof", "cohens_d", "diff", "ci_lo", "ci_hi"],
          ints=["n_a", "n_b"])
def rush_effect(spark, sf_dir):
    """H1-H4: rush vs off-peak Welch t, df, Cohen's d and 95 % CI per series."""
    return hyp.welch_effect(clean_events(spark, sf_dir), "value", "is_rush_hour", ["event_type"])


# the tail of the density by Simpson's rule, beyond |t| stretched to the unit interval
_TTEST_SQL = f"""
WITH e AS ({_EFFECT_SQL}),
g AS (SELECT event_type, abs(t_stat) AS t, dof, unnest(range(0, 4000)) / 4000.0 AS u FROM e),
f AS (SELECT event_type, dof, CASE WHEN u = 0 THEN 1 WHEN CAST(round(u * 4000) AS BIGINT) % 2 = 1 THEN 4 ELSE 2 END
             * exp(-(dof + 1) / 2 * ln(1 + power(t + u / (1 - u), 2) / dof)) / power(1 - u, 2) AS v FROM g),
p AS (SELECT event_type, 2 * sum(v) / 12000 * exp(lgamma((any_value(dof) + 1) / 2) - lgamma(any_value(dof) / 2)) / sqrt(any_value(dof) * pi()) AS p_value
      FROM f GROUP BY event_type)
SELECT event_type, n_a, n_b, mean_a, mean_b, t_stat, dof, cohens_d, diff, ci_lo, ci_hi, round(p_value, 7) AS p_value,
       CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END AS significant,
       CASE WHEN abs(cohens_d) > 0.8 THEN 'Large (>0.8)' WHEN abs(cohens_d) > 0.5 THEN 'Medium (0.5-0.8)' ELSE 'Small (<0.5)' END AS effect_size,
       (mean_b - mean_a) / mean_a * 100 AS uplift_pct FROM e JOIN p USING (event_type)"""


@register("rush_ttest", _TTEST_SQL, floats=["mean_a", "mean_b", "t_stat", "dof", "cohens_d", "diff", "ci_lo", "ci_hi", "p_value", "uplift_pct"],
          ints=["n_a", "n_b", "significant"])
def rush_ttest(spark, sf_dir):
    """H2: Welch test with its two-sided p-value, effect label, uplift."""
    test = hyp.welch_test(clean_events(spark, sf_dir), "value", "is_rush_hour", ["event_type"])
    return test.withColumn("p_value", F.round("p_value", 7))


@register("rush_decision")
def rush_decision(spark, sf_dir):
    """H5: decision table (metric, result) for the whole table's rush test."""
    test = hyp.welch_test(clean_events(spark, sf_dir), "value", "is_rush_hour")
    return hyp.decision_table(test)


@register("jarque_bera", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, n, g1, g2, n / 6.0 * (g1 * g1 + g2 * g2 / 4.0) AS jb,
       exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0) AS p_value,
       CASE WHEN exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0) > 0.05 THEN 1 ELSE 0 END AS normal
FROM (SELECT count(x) AS n,
             avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS g1,
             avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3 AS g2
      FROM (SELECT {c} AS x, avg({c}) OVER () AS mu FROM lineitem WHERE {c} IS NOT NULL))"""
    for c in LINEITEM_NUMERIC), floats=["g1", "g2", "jb", "p_value"], ints=["n", "normal"])
def jarque_bera(spark, sf_dir):
    """H6 companion on whole columns: Jarque-Bera from one moments pass."""
    return hyp.jarque_bera(read_table(spark, sf_dir, "lineitem"), list(LINEITEM_NUMERIC))


_LILLIE_SQL = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS d
FROM (SELECT i, n, mean, std, {norm_cdf_sql('z')} AS cdf FROM (
  SELECT row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, avg({c}) OVER () AS mean, stddev_samp({c}) OVER () AS std,
         ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z FROM lineitem WHERE {c} IS NOT NULL))"""
    for c in LINEITEM_NUMERIC)


@register("lilliefors_lineitem", f"""
SELECT *, 0.0 AS p_value, 0 AS normal FROM ({_LILLIE_SQL})""", floats=["mean", "std", "d", "p_value"], ints=["n", "normal"])
def lilliefors_lineitem(spark, sf_dir):
    """H6 on whole columns: distance to the fitted normal; these uniform columns are far from it (p below 1e-9 is shown as 0)."""
    test = hyp.lilliefors_test(read_table(spark, sf_dir, "lineitem"), list(LINEITEM_NUMERIC))
    return test.withColumn("p_value", F.round("p_value", 9))


@register("shapiro_lineitem")
def shapiro_lineitem(spark, sf_dir):
    """H6: Shapiro-Wilk on a deterministic 500-row hash sample per column."""
    return hyp.shapiro_test(read_table(spark, sf_dir, "lineitem"), list(LINEITEM_NUMERIC))


_QQ_V = ("CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1.0 - power(0.5, 1.0 / n) "
         "ELSE (i - 0.3175) / (n + 0.365) END")


@register("qq_points", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal) AS i, c_acctbal AS osr, count(*) OVER () AS n
           FROM customer WHERE c_acctbal IS NOT NULL),
v AS (SELECT i, osr, {_QQ_V} AS p FROM r)
SELECT i, osr, {norm_ppf_sql('p')} AS osm FROM v""", floats=["osr", "osm"], ints=["i"])
def qq_points(spark, sf_dir):
    """H7: probability-plot points with distributed ranking (no single-task sort)."""
    return hyp.qq_points(read_table(spark, sf_dir, "customer"), "c_acctbal")


@register("qq_fit", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal) AS i, c_acctbal AS osr, count(*) OVER () AS n
           FROM customer WHERE c_acctbal IS NOT NULL),
v AS (SELECT i, osr, {_QQ_V} AS p FROM r),
q AS (SELECT osr, {norm_ppf_sql('p')} AS osm FROM v)
SELECT regr_slope(osr, osm) AS slope, regr_intercept(osr, osm) AS intercept, corr(osr, osm) AS r FROM q""",
          floats=["slope", "intercept", "r"])
def qq_fit(spark, sf_dir):
    """H7 line through the probability plot."""
    return hyp.qq_fit(hyp.qq_points(read_table(spark, sf_dir, "customer"), "c_acctbal"))


@register("qq_grid", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n, l_extendedprice AS osr FROM lineitem),
j AS (SELECT unnest(range(1, 1001)) AS i),
g AS (SELECT i, (i - 0.5) / 1000 AS p, osr FROM j JOIN r ON k = ((2 * i - 1) * n + 1999) // 2000)
SELECT i, p, osr, {norm_ppf_sql('p')} AS osm FROM g""", floats=["p", "osr", "osm"], ints=["i"])
def qq_grid(spark, sf_dir):
    """H7 at scale: 1000-point probability plot of the whole column, at exact ranks."""
    return hyp.qq_grid(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", exact=True)
