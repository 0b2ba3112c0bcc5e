"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

from tallyloom.plans.tables import RAW

DATA = os.environ.get("TALLYLOOM_TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in RAW:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, connection, sql: str) -> str | None:
    """None when both give the same rows, else a short description."""
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = _rows(result.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:1], [r for r in want if r not in set(got)][:1]
        return f"rows {len(got)} vs {len(want)}; only one side: {str(extra)[:600]}"
    for a, b in zip(got, want):
        if a != b:
            cells = [(n, x[:200], y[:200]) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"values differ in {sum(x != y for x, y in zip(got, want))} rows, e.g. {str(cells)[:900]}"
    return None
