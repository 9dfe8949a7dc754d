"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

    python scripts/check_oracle.py [--sf /root/testdata/sf0.01] [name ...]

Prints one line per query: row counts, column match and whether the
order-insensitive row multisets are equal.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from souk.registry import QUERIES, oracle_sql, spark_query  # noqa: E402
from souk.session import build_session  # noqa: E402

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if hasattr(v, "item"):
        return _value(v.item())
    return v


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(_value)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain", action="store_true",
                    help="default session settings (as an outside caller would have)")
    ap.add_argument("--hot-key-rows", type=int, default=None,
                    help="split keys above this many rows (exercise the salted joins)")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.plain:
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session("local[8]", 8)
    if args.hot_key_rows:
        from souk.plans.skew import HOT_KEY_ROWS

        spark.conf.set(HOT_KEY_ROWS, str(args.hot_key_rows))
    con = duck(args.sf)
    names = args.names or list(QUERIES)
    bad = 0
    for name in names:
        t0 = time.time()
        sdf = spark_query(name)(spark, args.sf)
        s = sdf.toPandas()
        ts = time.time() - t0
        q = oracle_sql(name)
        if q is None:
            print(f"{name:32s} spark={len(s):7d} rows-only ({ts:.1f}s)")
            continue
        d = con.sql(q).df()
        cols_ok = sorted(s.columns) == sorted(d.columns)
        same = False
        if cols_ok and len(s) == len(d):
            a, b = normalise(s), normalise(d)
            same = a.astype(str).equals(b.astype(str))
            if not same:
                diff = (a.astype(str) != b.astype(str)).any(axis=0)
                print("   differing columns:", list(diff[diff].index))
                print(a[diff[diff].index].head(3).to_string())
                print(b[diff[diff].index].head(3).to_string())
        ok = cols_ok and same
        bad += not ok
        print(
            f"{name:32s} spark={len(s):7d} duck={len(d):7d} cols={'ok' if cols_ok else 'DIFF'} "
            f"values={'ok' if same else 'DIFF'} ({ts:.1f}s)"
        )
        if not cols_ok:
            print("   spark:", sorted(s.columns), "\n   duck: ", sorted(d.columns))
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
