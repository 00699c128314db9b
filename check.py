"""Compare registered queries with their SQL twins on one data folder.

    python check.py [/root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from shotline.plans import QUERIES, SQL
from shotline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def text(v) -> str:
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            try:
                return f"{float(v) + 0.0:.9g}"
            except (TypeError, ValueError):
                return str(v)
        return str(v)

    return sorted("|".join(text(v) for v in row) for row in frame.itertuples(index=False))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} <> {sorted(sql_frame.columns)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    if a == b:
        return "" if a else "EMPTY"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} vs {len(b)} rows; spark only {len(only_a)} {only_a[:3]}; sql only {len(only_b)} {only_b[:3]}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    names = [n for n in QUERIES if not prefixes or any(n.startswith(p) for p in prefixes)]
    # CHECK_PLAIN=1: a session without the recommended settings
    plain = SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false")
    spark = plain.getOrCreate() if os.environ.get("CHECK_PLAIN") else local_session()
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            result = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name in SQL:
                begin = time.time()
                verdict = compare(result, con.execute(SQL[name]).df())
                sql_took = time.time() - begin
            else:
                verdict, sql_took = ("" if len(result) else "EMPTY"), 0.0
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            verdict, took, sql_took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {took:6.2f}s {sql_took:6.2f}s {name} {verdict}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
