"""Comparing a query with its SQL, the way results are compared by value."""

import datetime
import decimal
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        name = f.removesuffix(".parquet")
        at = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"create view {name} as select * from '{at}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
