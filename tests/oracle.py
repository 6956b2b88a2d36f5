"""Compares a query with its SQL on the same tables: columns, types and the multiset of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(value)
    return value


def _bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What is not equal; empty when the results agree."""
    rows = df.collect()
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    wanted = got.fetchall()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    types = {c[0]: str(c[1]) for c in got.description}
    for name, kind in df.dtypes:
        if _TYPES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    if len(rows) != len(wanted):
        found.append(f"rows {len(rows)} != {len(wanted)}")
    a, b = _bag(rows, df.columns), _bag(wanted, names)
    if a != b:
        found.append(f"only in Spark: {list((a - b).items())[:3]}"[:1500])
        found.append(f"only in SQL: {list((b - a).items())[:3]}"[:1500])
    if not rows:
        found.append("no rows")
    return found
