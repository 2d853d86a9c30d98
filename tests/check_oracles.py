"""Run registered queries and their DuckDB SQL side by side: python tests/check_oracles.py [sf_dir] [name part ...]"""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def normal(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def compare(con, df, sql) -> str:
    """'' when equal, else what differs."""
    rows = as_rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = as_rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    if len(rows) != len(expected):
        extra = [r for r in rows if r not in set(expected)][:2]
        missing = [r for r in expected if r not in set(rows)][:2]
        return f"rows {len(rows)} vs {len(expected)}; only spark {extra}; only sql {missing}"
    if [tuple(map(repr, r)) for r in rows] != [tuple(map(repr, r)) for r in expected]:
        names = sorted(names)
        for a, b in zip(rows, expected):
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if repr(x) != repr(y)]
            if bad:
                return f"values {[(n, str(x)[:200], str(y)[:200]) for n, x, y in bad][:4]} in {str(a)[:300]}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = compare(con, df, oracles[name]) if name in oracles else f"(no sql) {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:1200]}"
        ok = not problem or problem.startswith("(no sql)")
        failed += [] if ok else [name]
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", problem, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
