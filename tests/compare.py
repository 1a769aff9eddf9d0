"""Run queries and their SQL side by side on the given tables."""

from __future__ import annotations

import datetime as dt
import importlib.util
import math
import os
import pathlib
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(ROOT, "__spark_entry__.py")
    )
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def database(root: str):
    con = duckdb.connect()
    for path in sorted(pathlib.Path(root).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    cells = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(cells, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    want_names, want = _rows(result.columns, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = [(type(a), type(b)) for a, b in zip(got[0], want[0])] if got else []
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    mixed = [k for k in kinds if k[0] is not k[1]]
    return f"types differ {mixed}" if mixed else None


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    from basketry.session import local_session

    root = sys.argv[1]
    entry = load_entry()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(root)
    sql = entry.oracle_sql()
    queries = entry.queries()
    chosen = sys.argv[2:] or list(queries)
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    failed = 0
    for key in chosen:
        started = time.time()
        try:
            found = difference(queries[key](spark, root), con, sql[key])
        except Exception as error:  # report every query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{key:32s} {time.time() - started:6.2f}s", "ok" if found is None else f"FAIL {found}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")
