"""Compare a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(rows, names):
    def value(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if math.isnan(v) else f"{float(v):.10g}"
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Assert equal rows; returns how many there are."""
    rel = con.sql(sql)
    want = normal(rel.fetchall(), rel.columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
