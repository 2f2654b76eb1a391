"""Comparison of a query with its SQL twin, as sets of rows."""

from __future__ import annotations

import decimal
import math

import duckdb
import pandas as pd

from quarry.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def same(frame, relation) -> None:
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert mine == theirs
