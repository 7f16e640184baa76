"""Spark results held against DuckDB SQL over the same files."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    own = duckdb.connect()
    own.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return own


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return "null" if x is None else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, own, sql):
    """None, or what differs."""
    mine = rows_of(df.columns, df.collect())
    found = own.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}"
    return next((f"{a} and {b}" for a, b in zip(mine[1], theirs[1]) if a != b), None)
