"""Holds a query's rows against its DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if the rows are the same, else what differs."""
    rel = con.sql(sql)
    want_names = list(rel.columns)
    got = df.collect()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} / {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, rel.fetchall())
    if a == b:
        return ""
    extra, missing = [x for x in a if x not in b][:3] if len(a) < 5000 else [], [x for x in b if x not in a][:3] if len(a) < 5000 else []
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} rows / {len(b)} rows; only Spark: {extra}; only SQL: {missing}; first: {first}; columns {sorted(df.columns)}"
