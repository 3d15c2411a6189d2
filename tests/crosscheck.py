"""Compare registered queries with their SQL in DuckDB: python tests/crosscheck.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:19]
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    result = con.sql(sql)
    want_columns = list(result.columns)
    want = rows_of(want_columns, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(set(df.columns) ^ set(want_columns))}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:1]
        missing = [r for r in want if r not in set(got)][:1]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}", len(got)
    names = sorted(df.columns)
    for g, w in zip(got, want):
        if g != w:
            bad = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
            return f"values {bad[:4]}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]").appName("crosscheck")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = None, df.count()
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} rows={n} {time.time() - start:.2f}s"
              f"{'' if name in oracles else ' (no sql)'} {problem or ''}", flush=True)
    print("failures:", bad, "of", len(args or queries), "; oracles without query:", set(oracles) - set(queries))


if __name__ == "__main__":
    main()
