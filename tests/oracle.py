"""Compares a query's rows with those of its SQL in DuckDB over the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    """Values as they compare: numbers of all kinds, sequences as tuples, bytes."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, bytearray):
        return bytes(x)
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in x.asDict().items())
    return x


def differences(got, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    found = con.execute(sql)
    names = sorted(x[0] for x in found.description)
    if names != sorted(got.columns):
        return f"columns {sorted(got.columns)}, SQL has {names}"
    place = {x[0]: i for i, x in enumerate(found.description)}
    want = Counter(tuple(plain(r[place[n]]) for n in names) for r in found.fetchall())
    have = Counter(tuple(plain(r[n]) for n in names) for r in got.select(*[f"`{n}`" for n in names]).collect())
    if want == have:
        return ""
    return f"{names}: {sum(have.values())} rows, SQL has {sum(want.values())}; only here {list((have - want).items())[:3]}, only in SQL {list((want - have).items())[:3]}"
