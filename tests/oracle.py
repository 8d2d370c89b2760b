"""Compare a query with its SQL twin on the same parquet tables, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(root).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "").removesuffix(" 00:00:00")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    return v if isinstance(v, str) else str(v)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    got_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    got, want = rows(df.columns, got_rows), rows(cols, rel.fetchall())
    if got == want:
        return ""
    extra, lost = got - want, want - got
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list(extra)[:3]}; only in SQL {list(lost)[:3]}"
