"""Result presentation for engine-independent comparison.

Registered queries return doubles that are whole numbers exactly and other doubles in
single precision, integers as bigint and timestamps as ``yyyy-MM-dd HH:mm:ss`` text, so a result computed by Spark and
the same result computed by another SQL engine compare equal despite
last-digit differences in floating-point summation order.  ``oracle`` wraps a
SQL query the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def present(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # whole numbers exactly; others to single precision, where engines agree
            d = c.cast("double")
            c = F.when(F.rint(d) == d, d).otherwise(c.cast("float").cast("double"))
        elif isinstance(f.dataType, INTS):
            c = c.cast("bigint")
        elif isinstance(f.dataType, TIMES):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(out)


def oracle(inner: str, floats: Sequence[str] = (), ints: Sequence[str] = (),
           times: Sequence[str] = ()) -> str:
    """Wrap DuckDB SQL so its output types match ``present``."""
    repl = ([f"CASE WHEN round(CAST({c} AS DOUBLE)) = {c} THEN CAST({c} AS DOUBLE) "
             f"ELSE CAST(CAST({c} AS FLOAT) AS DOUBLE) END AS {c}" for c in floats]
            + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times])
    if not repl:
        return inner
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{inner}\n) AS q"
