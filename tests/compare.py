"""Compare a query's Spark result with its SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, query, oracle: str, sf_dir: str) -> str:
    """An empty string if they agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows and {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(diff)} of {len(got[1])} rows differ: {diff[:3]}" if diff else ""
