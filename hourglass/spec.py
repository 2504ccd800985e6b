"""Column roles of a keyed, timestamped measurement table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .functions.scalar import col_of


@dataclass
class SeriesSpec:
    """Where the time, series keys and each role group live in a table."""

    ts: str = "ts"
    keys: Sequence[str] = ()
    targets: Sequence[str] = ()
    sensors: Sequence[str] = ()
    covariates: Sequence[str] = ()
    calendar: Sequence[str] = ("hour", "month", "weekday", "weekend", "is_rush_hour")
    descriptions: dict[str, str] = field(default_factory=dict)

    def group(self, role: str) -> list[str]:
        return list(getattr(self, role))

    def roles(self) -> dict[str, tuple[str, str]]:
        out = {}
        for role in ("targets", "sensors", "covariates", "calendar"):
            for c in getattr(self, role):
                out[c] = (role.rstrip("s"), self.descriptions.get(c, ""))
        return out

    def select(self, df: DataFrame, role: str, with_time: bool = True) -> DataFrame:
        """Project one role group (plus time and keys)."""
        cols = ([self.ts] if with_time else []) + list(self.keys) + self.group(role)
        return df.select([col_of(c) for c in cols if c in df.columns])


# --- fixed values: column names of the air-quality table the dashboard reads ---
AIR_QUALITY = SeriesSpec(
    ts="Datetime",
    targets=("CO(GT)", "C6H6(GT)", "NOx(GT)", "NO2(GT)"),
    sensors=("PT08.S1(CO)", "PT08.S2(NMHC)", "PT08.S3(NOx)", "PT08.S4(NO2)", "PT08.S5(O3)"),
    covariates=("T", "RH", "AH"),
)
