"""Runs a query and its DuckDB twin on the same tables and compares names, types and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
    "array<double>": "DOUBLE[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, dt.datetime):
        return (2, v.isoformat())
    return (3, str(v))


def compare(spark, con, folder, name, run, text):
    """None when equal, else what differs."""
    ours = run(spark, folder)
    names = sorted(ours.columns)
    rel = con.sql(text)
    if sorted(rel.columns) != names:
        return f"{name}: columns {names} against {sorted(rel.columns)}"
    have = {n: TYPES.get(t, t) for n, t in ours.dtypes}
    want = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if have != want:
        return f"{name}: types " + str({n: (have[n], want[n]) for n in names if have[n] != want[n]})
    left = sorted([_cell(v) for v in row] for row in ours.select(*[f"`{n}`" for n in names]).collect())
    right = sorted([_cell(v) for v in row] for row in rel.select(*[f'"{n}"' for n in names]).fetchall())
    if len(left) != len(right):
        return f"{name}: {len(left)} rows against {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{name}: {len(bad)} of {len(left)} rows differ, first {bad[:2]}"
    return None
