"""Findings report (S5): each published claim is computed from the data and
marked held / not held, instead of being fixed prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio

# --- fixed values: the claims the dashboard states, as (low, high) ranges ---
CLAIMS = {
    "rush_uplift_pct": (30.0, 40.0),
    "weekday_uplift_pct": (20.0, 30.0),
    "rush_share_pct": (20.0, 30.0),
    "high_class_pct": (45.0, 55.0),
}
# ------------------------------------------------------------------------------


def findings(clean: DataFrame, value: str = "value") -> DataFrame:
    """One pass over the cleaned table -> long (metric, value, claim range, held / not held / n/a)."""
    x = F.col(value)
    rush, wkend = F.col("is_rush_hour"), F.col("weekend")
    one = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(rush == 0, x)).alias("off"), F.avg(F.when(rush == 1, x)).alias("on"),
        F.avg(F.when(wkend == 0, x)).alias("wd"), F.avg(F.when(wkend == 1, x)).alias("we"),
        F.avg(rush.cast("double")).alias("rush_share"),
        F.avg(F.col("high_pollution").cast("double")).alias("high_share"),
        F.var_samp(F.when(rush == 0, x)).alias("v_off"), F.var_samp(F.when(rush == 1, x)).alias("v_on"))
    metrics = {
        "rows": F.col("rows").cast("double"),
        "columns": F.lit(float(len(clean.columns))),
        "rush_uplift_pct": ratio(F.col("on") - F.col("off"), F.col("off")) * 100.0,
        "weekday_uplift_pct": ratio(F.col("wd") - F.col("we"), F.col("we")) * 100.0,
        "rush_share_pct": F.col("rush_share") * 100.0,
        "high_class_pct": F.col("high_share") * 100.0,
        "cohens_d_rush": ratio(F.col("on") - F.col("off"), F.sqrt((F.col("v_off") + F.col("v_on")) / 2)),
    }
    rows = []
    for name, expr in metrics.items():
        lo, hi = CLAIMS.get(name, (None, None))
        lo_c, hi_c = F.lit(lo).cast("double"), F.lit(hi).cast("double")
        held = (F.when(lo_c.isNull(), F.lit("n/a"))
                .when((expr >= lo_c) & (expr <= hi_c), F.lit("held")).otherwise(F.lit("not held")))
        rows.append(F.struct(F.lit(name).alias("metric"), expr.alias("value"), lo_c.alias("claim_low"),
                             hi_c.alias("claim_high"), held.alias("held")))
    return one.select(F.inline(F.array(*rows)))
