"""Runs a query and its SQL on the same tables and compares the rows, without regard to their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create view {p.stem} as select * from '{files}'")
    return con


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        return f"{float(x):.5g}" if isinstance(x, float) or type(x).__name__.startswith("float") else str(int(x))
    return str(x)


def rows(frame, columns):
    return sorted(tuple(_plain(x) for x in r) for r in frame[columns].itertuples(index=False, name=None))


def compared(spark, query, sql, sf_dir=DATA):
    ours = query(spark, sf_dir).toPandas()
    theirs = connection(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:5]
    return len(a)
