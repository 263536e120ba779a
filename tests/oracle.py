"""Comparing a query with its SQL in DuckDB."""

import datetime
import decimal
import math
import os
from collections import Counter


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(tidy(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def duck(directory):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(directory):
        path = os.path.join(directory, f)
        c.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def assert_same(df, connection, sql):
    names, ours = rows_of(df)
    r = connection.sql(sql)
    assert sorted(r.columns) == names
    at = [r.columns.index(c) for c in names]
    theirs = Counter(tuple(tidy(x[i]) for i in at) for x in r.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
