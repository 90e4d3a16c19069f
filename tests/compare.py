"""Compare registered queries with their SQL on DuckDB, by value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(body, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, connection, sql, tolerance=2e-6):
    """Empty text when the Spark result equals the SQL result."""
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = connection.execute(sql)
    other_names, other_rows = canonical([d[0] for d in relation.description], relation.fetchall())
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows vs {len(other_rows)}; first {rows[:2]} vs {other_rows[:2]}"
    exact = 0
    for mine, other in zip(rows, other_rows):
        for a, b in zip(mine, other):
            if a == b:
                continue
            if isinstance(a, float) and isinstance(b, float) and abs(a - b) <= tolerance * max(1, abs(a)):
                exact += 1
                continue
            return f"{names}: {mine} vs {other}"
    return f"{exact} cells differ in the last digit" if exact else ""
