"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if isinstance(v, bool) or v is None:
        return v
    return int(v) if isinstance(v, int) else str(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, con) -> tuple[list[tuple], list[tuple], bool]:
    """Both row lists and whether names and values agree."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got, want, sorted(names) == sorted(df.columns) and got == want
