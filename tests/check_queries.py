"""Run registered queries against their check SQL in DuckDB: python -m tests.check_queries [folder] [name part ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

import __spark_entry__ as contract
from outlay.session import build_session
from outlay.sources.sample import TABLES


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def database(path):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def compare(name, build, sql, spark, path, con):
    """(ok, message) for one query."""
    df = build(spark, path)
    columns, rows = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_columns, want = table(names, cur.fetchall())
    if columns != want_columns:
        return False, f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return False, f"{len(rows)} rows, expected {len(want)}; first {rows[:2]} / {want[:2]}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(rows)} rows differ; {bad[0]}"
    kinds = [(a, b) for a, b in zip(rows[0], want[0]) if type(a) is not type(b) and None not in (a, b)] if rows else []
    return not kinds, f"{len(rows)} rows" + (f" but types differ {kinds}" if kinds else "")


def main(argv):
    path = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(path)
    sqls, failed = contract.oracle_sql(), []
    for name, build in contract.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, message = compare(name, build, sqls.get(name), spark, path, con)
        except Exception as error:  # report and go on to the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {time.time() - start:5.1f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
