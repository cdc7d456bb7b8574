"""Run registered queries against their SQL in DuckDB: ``python tests/oracle_check.py [sf] [name...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return value
    return str(value)


def normal(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    """'' if both agree, else what differs."""
    result = query(spark, folder)
    rows = [tuple(r) for r in result.collect()]
    if sql is None:
        return "" if rows else "no rows"
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(set(names) ^ set(result.columns))}"
    ours, theirs = normal(result.columns, rows), normal(names, answer.fetchall())
    if ours == theirs:
        return ""
    missing, extra = list((theirs - ours).items())[:3], list((ours - theirs).items())[:3]
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; missing {missing}; extra {extra}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from duelens.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connection(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            difference = compare(spark, con, folder, name, query, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(difference)
        kind = "" if name in sqls else " (rows only)"
        print(f"{'FAIL' if difference else 'ok  '} {name}{kind} {time.time() - start:.1f}s {difference[:1500]}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
