"""Comparison of a query's rows with those of its SQL: names, count and values, order aside."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return f"{type(value).__name__}:{value}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str | None:
    """None when both agree, else the first differences."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if actual == expected:
        return None if expected else "both are empty"
    extra, missing = list((actual - expected).elements()), list((expected - actual).elements())
    return (f"{sum(actual.values())} against {sum(expected.values())} rows, columns {sorted(names)}; "
            f"only here {[str(r)[:300] for r in extra[:2]]}; only there {[str(r)[:300] for r in missing[:2]]}")
