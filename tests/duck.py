"""Compares a query with its SQL twin in DuckDB, over the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def assert_same(spark, query, sql):
    """The same rows with the same values, to the last bit."""
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = connection().sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:2])
