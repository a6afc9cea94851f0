"""Side-by-side comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import os

import duckdb

from lodestone.sources import TABLES


def connect(directory: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{directory}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return db


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=key)


def assert_same(frame, directory: str, sql: str) -> None:
    found = connect(directory).execute(sql)
    want = bag([c[0] for c in found.description], found.fetchall())
    got = bag(frame.columns, [tuple(row) for row in frame.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
