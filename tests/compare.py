"""Results of Spark and of DuckDB, brought to one form and compared whole."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET threads = 4")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if Path(path).exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return db


def rows_of_duck(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    return shaped(names, got.fetchall())


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    return shaped(df.columns, [tuple(_plain_row(x) for x in r) for r in df.collect()])


def _plain_row(x):
    return x.asDict(recursive=True) if hasattr(x, "asDict") else [_plain_row(y) for y in x] if isinstance(x, list) else x


def shaped(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(left, right) -> str:
    """Empty if both hold the same rows."""
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} and {len(right[1])} rows"
    for a, b in zip(left[1], right[1], strict=True):
        if a != b:
            return f"{a!r:.600} and {b!r:.600}"
    return ""
