"""Run a query on Spark and its SQL on DuckDB and compare all rows and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, connection, sql: str) -> str | None:
    """None if both agree, else what differs."""
    result = connection.execute(sql)
    want = _rows([d[0] for d in result.description], result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        return f"{sum(got[1].values())} rows instead of {sum(want[1].values())}; extra {list(extra)[:3]}; missing {list(missing)[:3]}"
    return None if sum(want[1].values()) else "no rows"
