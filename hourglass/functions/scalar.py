"""Column expressions: cleaning, calendar features, labels and bands.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values the results depend on (must match the source dashboard) ---
SENTINEL = -200
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
SEASON_OF_MONTH = {
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Autumn", 10: "Autumn", 11: "Autumn",
    12: "Winter", 1: "Winter", 2: "Winter",
}
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
VIF_BANDS = ((10.0, "High (>10)"), (5.0, "Medium (5-10)"))
VIF_ELSE = "Low (<5)"
SKEW_BANDS = ((0.5, "Right-skewed"),)
EFFECT_BANDS = ((0.8, "Large (>0.8)"), (0.5, "Medium (0.5-0.8)"))
EFFECT_ELSE = "Small (<0.5)"
STRONG_R, STRONG_SKEW = 0.6, 1.0
CO_REFERENCE = 1.8
SEVERITY_STEPS = ((1.8, "Low"), (5.0, "Moderate"), (12.0, "High"))
SEVERITY_ELSE = "Very high"
# -----------------------------------------------------------------------------


def col_of(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0 (plain division raises under ANSI SQL)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a, b)


def sentinel_to_null(c, sentinel: float = SENTINEL) -> Column:
    """The sentinel (as int or double) and NaN become SQL NULL."""
    x = col_of(c)
    return F.when(F.isnan(x) | (x == F.lit(sentinel)), F.lit(None)).otherwise(x)


def nan_to_null(c) -> Column:
    x = col_of(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def parse_datetime(date_col, time_col, fmt: str = "M/d/yyyy H:mm:ss") -> Column:
    """Join date and time strings; NULL when either part is missing or bad."""
    d, t = col_of(date_col), col_of(time_col)
    joined = F.concat_ws(" ", d, t)
    parsed = F.try_to_timestamp(joined, F.lit(fmt)).cast("timestamp_ntz")
    return F.when(d.isNotNull() & t.isNotNull(), parsed)


def weekday(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(col_of(ts))


def season(month) -> Column:
    m = col_of(month)
    out = None
    for name, months in _group_months().items():
        cond = m.isin(*months)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def _group_months() -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for month, name in SEASON_OF_MONTH.items():
        groups.setdefault(name, []).append(month)
    return groups


def is_rush_hour(hour, hours: Sequence[int] = RUSH_HOURS) -> Column:
    return col_of(hour).isin(*hours).cast("int")


def calendar_columns(ts, prefix: str = "", rush_hours: Sequence[int] = RUSH_HOURS) -> dict[str, Column]:
    """Hour, day, month, weekday, weekend, season, rush flag."""
    t = col_of(ts)
    wd = weekday(t)
    return {
        f"{prefix}hour": F.hour(t),
        f"{prefix}day": F.dayofmonth(t),
        f"{prefix}month": F.month(t),
        f"{prefix}weekday": wd,
        f"{prefix}weekend": (wd >= 5).cast("int"),
        f"{prefix}season": season(F.month(t)),
        f"{prefix}is_rush_hour": is_rush_hour(F.hour(t), rush_hours),
    }


def day_name(weekday_col) -> Column:
    """0..6 -> Mon..Sun."""
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), col_of(weekday_col) + 1)


def month_name(month_col) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), col_of(month_col))


def rush_label(flag_col) -> Column:
    return F.when(col_of(flag_col) == 1, F.lit("Rush Hour")).otherwise(F.lit("Off-Peak"))


def bucket_label(c, bands: Iterable[tuple[float, str]], otherwise: str, absolute: bool = False) -> Column:
    """P10: first band whose threshold is strictly exceeded, else ``otherwise``."""
    x = col_of(c)
    if absolute:
        x = F.abs(x)
    out = None
    for threshold, label in bands:
        cond = x > F.lit(threshold)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def exceeds(c, threshold: float) -> Column:
    """P10 flag: 1 if the size of a figure is strictly above ``threshold``, NULL without a figure."""
    return (F.abs(col_of(c)) > F.lit(threshold)).cast("int")


def skew_shape(c) -> Column:
    x = col_of(c)
    return (F.when(x > 0.5, F.lit("Right-skewed"))
            .when(x < -0.5, F.lit("Left-skewed"))
            .otherwise(F.lit("Approx. Normal")))


def severity_band(c, steps=SEVERITY_STEPS, otherwise: str = SEVERITY_ELSE) -> Column:
    """Gauge band; value at or below each step's upper edge."""
    x = col_of(c)
    out = None
    for upper, label in steps:
        cond = x <= F.lit(upper)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))
