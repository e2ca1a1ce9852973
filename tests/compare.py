"""Run registered queries and their SQL side by side: ``python tests/compare.py SF [NAME ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def compare(spark, con, sf: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    mine = rows_of(df.columns, rows)
    if sql is None:
        return False, f"{len(mine)} rows, no SQL, {took:.1f}s"
    start = time.time()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    other = rows_of(names, found.fetchall())
    note = f"{len(mine)} rows, {took:.1f}s, SQL {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine == other:
        return True, note
    gap = [(a, b) for a, b in zip(mine, other) if a != b][:2]
    return False, f"{note}; SQL has {len(other)} rows; {str(gap)[:1500]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", os.environ.get("TEST_TZ", "UTC")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    bad = []
    for name in wanted:
        try:
            good, note = compare(spark, con, sf, queries[name], oracle.get(name))
        except Exception as failure:
            good, note = False, "".join(traceback.format_exception_only(failure))[:1500]
        print("ok " if good else "BAD", name, note, flush=True)
        if not good:
            bad.append(name)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
