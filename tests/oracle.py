"""Compares a query's rows with its SQL's, as multisets of values by column name."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def check(df, sql: str, con) -> None:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = Counter(tuple(plain(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    extra, absent = list((got - want).items())[:3], list((want - got).items())[:3]
    assert got == want, f"{sum(got.values())} rows, {sum(want.values())} wanted; extra {extra}, absent {absent}"
