"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _cell(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if hasattr(x, "quantize"):
        return float(f"{float(x):.9g}")
    return str(x)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    columns = [c[0] for c in res.description]
    want = rows_of(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows and {len(want)}; only in SQL {missing}; only in Spark {extra}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
