"""Comparison of a registered query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

import __spark_entry__ as entry
from srcloom.plans.fixtures import TABLES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def same_as_sql(spark, name: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=key)
