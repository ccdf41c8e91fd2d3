"""Rows of a Spark query and of its DuckDB oracle in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    """Numbers by value, times without zone, containers as tuples."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, values) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(((tuple(plain(row[i]) for i in order)) for row in values), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def spark_rows(df) -> tuple[list[str], list]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
