"""Compare a Spark result with DuckDB: columns, row count and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> str | None:
    """None when both sides agree, else a short account of the first difference."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "both empty"
    kinds = [{type(v) for r in side for v in [r[i]] if v is not None} for side in (got, want)
             for i in range(len(want_names))]
    half = len(want_names)
    for i in range(half):
        if kinds[i] != kinds[half + i]:
            return f"types of {sorted(want_names)[i]}: {kinds[i]} != {kinds[half + i]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n  spark  {str(g)[:600]}\n  duckdb {str(w)[:600]}"
    return None
