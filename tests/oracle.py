"""Compare registered queries with their SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (2, repr(round(float(v), 6) + 0.0))
    return (3, str(v))


def compare(df, sql: str, sf_dir: str) -> list[str]:
    """Differences between a Spark result and a SQL result, empty when equal."""
    got = df.toArrow()
    res = connect(sf_dir).sql(sql)
    want_cols = res.columns
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    cols = sorted(want_cols)
    want = res.arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    rows = lambda t: sorted(tuple(_cell(v) for v in r) for r in zip(*[t.column(c).to_pylist() for c in cols]))
    g, w = rows(got), rows(want)
    if len(g) != len(w):
        problems.append(f"rows {len(g)} != {len(w)}")
    if g != w:
        gs, ws = set(g), set(w)
        problems.append(f"only spark: {sorted(gs - ws)[:3]} only sql: {sorted(ws - gs)[:3]}")
    for c in cols:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        if a != b and {a, b} - {"string", "large_string"}:
            problems.append(f"~type {c}: {a} / {b}")
    return problems
