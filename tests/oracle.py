"""Runs registered queries next to their SQL, as the driver does."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{root}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_cell(v)}" for k, v in value.items()) + "}"
    if hasattr(value, "asDict"):
        return _cell(value.asDict())
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.astimezone(__import__("datetime").timezone.utc).replace(tzinfo=None)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, root: str) -> None:
    got = query(spark, root)
    with duck(root) as con:
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        expected = rows_of(names, want.fetchall())
    assert sorted(got.columns) == sorted(names)
    actual = rows_of(got.columns, got.collect())
    assert len(actual) == len(expected), (len(actual), len(expected))
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not wrong, wrong[:3]
