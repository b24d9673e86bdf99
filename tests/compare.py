"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

from criticlens.plans.adapters import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is None, str(v)) for v in row])


def differences(df, sql: str, connection) -> list[str]:
    """Empty when names, rows and values agree."""
    mine = sorted_rows(df.columns, df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = sorted_rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if len(mine) != len(theirs):
        only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
        return [f"{len(mine)} rows against {len(theirs)}: {list(only_mine)[:2]} / {list(only_theirs)[:2]}"]
    wrong = [(a, b) for a, b in zip(mine, theirs) if repr(a) != repr(b)]
    return [f"{len(wrong)} of {len(mine)} rows, first {wrong[0]}"] if wrong else []
