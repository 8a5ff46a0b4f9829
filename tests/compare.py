"""Comparing a query with its SQL, as multisets of rows, columns by name."""

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def rows(values):
    return sorted(tuple(f"{x + 0.0:.9g}" if isinstance(x, float) else str(x) for x in r) for r in values)


def same(df, sql: str, folder: str) -> None:
    names = sorted(df.columns)
    found = connect(folder).execute(sql)
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    expected = [tuple(r[there.index(n)] for n in names) for r in found.fetchall()]
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(expected)
