"""Runs registered queries against their SQL on DuckDB: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x if isinstance(x, (int, str, bool, type(None))) else str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the frame and the SQL give the same rows."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows differ, as {odd[0]}"[:900] if odd else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sorted(oracle):
        began = time.time()
        try:
            said = difference(queries[name](spark, sys.argv[1]), con, oracle[name])
        except Exception as e:  # report and go on
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(name, f"{time.time() - began:.1f} s", said or "same", flush=True)
    del glob
