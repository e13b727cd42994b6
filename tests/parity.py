"""Run queries and their SQL side by side and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return value
    return value


def difference(frame, con, sql) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    rows = [tuple(r) for r in frame.select(*names).collect()]
    got = Counter(tuple(map(_plain, r)) for r in rows)
    want = Counter(tuple(map(_plain, r)) for r in wanted)
    if got == want:
        return None
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"{len(rows)} rows, wanted {len(wanted)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}"
