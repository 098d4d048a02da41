"""Runs a query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def database() -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in SMALL.iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def differing(df, db, sql: str) -> list:
    """Rows that only one side has."""
    cols = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    return [] if ours == theirs else [x for x in zip(ours, theirs, strict=False) if x[0] != x[1]][:3] or [(len(ours), len(theirs))]
