"""Compare a Spark result with the SQL result of another engine, independent of row order."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = pathlib.Path(sf_dir) / f"{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_norm(r[i]) for i in order]) for r in rows)


def mismatch(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        lack = [x for x in b if x not in set(a)][:2]
        return f"values differ: spark {extra} oracle {lack}"
    return None
