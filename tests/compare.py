"""Side-by-side comparison of a catalog query with its SQL statement."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        return float(value)
    return value.item() if hasattr(value, "item") else value


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in one fixed order, so both engines compare as sets with multiplicity."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda row: tuple((v is not None, str(v)) for v in row))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())
