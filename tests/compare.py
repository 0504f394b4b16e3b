"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return str(int(value)) if value == value.to_integral_value() else str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    left_columns = df.columns
    left = canonical(left_columns, [tuple(r) for r in df.collect()])
    con = connect(folder)
    cursor = con.execute(sql)
    right_columns = [d[0] for d in cursor.description]
    right = canonical(right_columns, cursor.fetchall())
    if sorted(left_columns) != sorted(right_columns):
        return f"{name}: columns {sorted(left_columns)} / {sorted(right_columns)}"
    if len(left) != len(right):
        return f"{name}: {len(left)} rows / {len(right)} rows"
    if not left:
        return f"{name}: no rows"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{name}: {len(different)} of {len(left)} rows differ, first {different[0]}"
    return None
