"""Registry of the queries run against the driver's tables.

Each entry maps a name to ``fn(spark, sf_dir) -> DataFrame`` and, where SQL
can express it, to DuckDB SQL computing the same result on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .present import oracle, present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, sql: str | None = None, floats=(), ints=(), times=()):
    def deco(fn):
        RAW[name] = fn
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: present(_fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql, floats, ints, times)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_profile  # noqa: F401
    from . import queries_relate  # noqa: F401
    from . import queries_timeseries  # noqa: F401
    from . import queries_tests  # noqa: F401
    from . import queries_ml  # noqa: F401
    from . import queries_neighbours  # noqa: F401
    from . import queries_trees  # noqa: F401
    from . import queries_svm  # noqa: F401
    from . import queries_linear  # noqa: F401
    from . import queries_sketches  # noqa: F401
    from . import queries_models  # noqa: F401
    from . import queries_sources  # noqa: F401
