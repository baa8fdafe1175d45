"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return x


def differences(spark, con, query, sql: str, sf: str) -> str:
    """What is not the same; empty if all is."""
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    result = con.execute(sql)
    there = [d[0] for d in result.description]
    if sorted(there) != names:
        return f"columns {names} and {sorted(there)}"
    at = [there.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    if got != want:
        first = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
        kinds = {type(x).__name__ for r in got[:1] for x in r} ^ {type(x).__name__ for r in want[:1] for x in r}
        return f"{len(got)} rows and {len(want)}; first difference {first}; types {kinds}"
    return ""
