"""Compare registered queries with their SQL run by DuckDB on the same files.

As a program: ``python tests/oracle.py [sf_dir] [name ..]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark, con, run, sql, sf_dir, timing: list | None = None) -> str | None:
    """None when equal, else what differs first."""
    start = time.time()
    df = run(spark, sf_dir)
    left_names, left = table_rows(df.columns, [tuple(r) for r in df.collect()])
    if timing is not None:
        timing.append(time.time() - start)
    cursor = con.execute(sql)
    right_names, right = table_rows([d[0] for d in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} / {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; first {left[:1]} / {right[:1]}"
    for a, b in zip(left, right):
        if a != b:
            return f"row {str(a)[:300]} / {str(b)[:300]}"
    kinds = {type(v) for row in left[:50] for v in row} ^ {type(v) for row in right[:50] for v in row}
    return f"types {kinds}" if kinds else None


def main() -> None:
    from pyspark.sql import SparkSession

    from tokenloom.plans.catalog import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args or list(QUERIES):
        start = time.time()
        spark_time: list[float] = []
        try:
            if name in ORACLES:
                found = difference(spark, con, QUERIES[name], ORACLES[name], sf_dir, spark_time)
            else:
                found = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            found = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += found is not None and not found.startswith("rows only")
        total = time.time() - start
        print(f"{total:6.2f}s  spark {sum(spark_time) or total:6.2f}s  {name:32s} {found or 'ok'}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
