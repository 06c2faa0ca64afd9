"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=repr)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in df.select(*names).collect()), key=repr)
