"""Run a registered query and its SQL on the same files and compare them as bags of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _key(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def rows(cols: list[str], data: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in data)


def compare(spark, con, sf: str, fn, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows(cols, rel.fetchall())
    df = fn(spark, sf)
    got = rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return None if got else "both are empty"
    a, b = set(got), set(want)
    return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
