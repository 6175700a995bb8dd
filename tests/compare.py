"""Runs a query in Spark and its SQL in DuckDB and says how they differ."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x.isoformat() if hasattr(x, "isoformat") else x


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = sorted((tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(cell(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows: {got[:2]} {want[:2]}"
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(odd)} of {len(got)} rows: {odd[:2]}" if odd else ("" if got else "no rows")
