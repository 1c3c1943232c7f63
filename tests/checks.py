"""Comparing query results with DuckDB."""

import math
import os

import duckdb

DATA = os.environ.get("SILTSTONE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str = DATA):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def order(row):
    return [(v is None, str(type(v)), round(v, 4) if isinstance(v, float) else str(v)) for v in row]


def assert_same(df, sql: str, folder: str = DATA):
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=order)
    found = database(folder).sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(close(x, y) for x, y in zip(g, w)), (g, w)
