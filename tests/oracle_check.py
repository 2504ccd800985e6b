"""Run registered queries in Spark and their SQL in DuckDB; compare like the driver.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from hourglass.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def digest(df):
    return hashlib.sha1(pd.util.hash_pandas_object(df, index=False).values.tobytes()).hexdigest()


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sql:
            print(f"rows {name}: {len(sdf)} rows (no oracle) {dt:.2f}s")
            continue
        try:
            ddf = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        a, b = norm(sdf), norm(ddf)
        same_cols = list(a.columns) == list(b.columns)
        types_a = [str(a[c].dtype) for c in a.columns]
        types_b = [str(b[c].dtype) for c in b.columns] if same_cols else []
        ok = same_cols and len(a) == len(b) and types_a == types_b and digest(a) == digest(b)
        if ok:
            print(f"ok   {name}: {len(a)} rows {dt:.2f}s")
        else:
            bad += 1
            print(f"FAIL {name}: cols {list(a.columns)} vs {list(b.columns)}; rows {len(a)} vs {len(b)}; "
                  f"types {types_a} vs {types_b}")
            if same_cols and len(a) == len(b):
                for c in a.columns:
                    diff = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
                    if diff.any():
                        i = diff.idxmax()
                        print(f"     first diff in {c} row {i}: {a[c][i]!r} vs {b[c][i]!r} ({diff.sum()} rows)")
    print(f"{bad} failing")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
