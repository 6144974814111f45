"""Run a query and its SQL over the same folder and compare the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

DATA = os.environ.get("SPECSIFT_TESTDATA", "/root/testdata/sf0.001")


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    return c


def norm(v: object) -> object:
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def compare(spark: object, query: object, sql: str, c: duckdb.DuckDBPyConnection, folder: str = DATA) -> int:
    """Asserts equal columns and rows; returns how many rows there were."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = Counter(repr(tuple(norm(r[k]) for k in cols)) for r in (x.asDict(True) for x in df.collect()))
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    theirs = Counter(repr(tuple(norm(r[k]) for k in at)) for r in result.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:2], list((theirs - ours).items())[:2])
    return sum(ours.values())
