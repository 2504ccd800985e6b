"""Joins on group keys: NULL is a group like any other, and small sides are measured before they are broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BROADCAST_ROWS = 50_000


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys come from ``left``."""
    keys = list(keys)
    if not keys:
        raise ValueError("key_join needs keys")
    side = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(side[f"__right_{k}"]) for k in keys])
    return left.join(side, same, how).drop(*[f"__right_{k}" for k in keys])


def measured(side: DataFrame) -> DataFrame:
    """A per-key table, computed once and counted: broadcast up to ``BROADCAST_ROWS`` rows, else shuffled.

    The data it joins then keeps its place, so a key that holds a third of all rows is not gathered anywhere."""
    side = materialise(side)
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side
