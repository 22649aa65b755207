"""Runs a query on Spark and its SQL on DuckDB and compares them as bags of rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value that compares equal across the two engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, map(tuple, df.collect()))
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (a, b)
    return len(ours)
