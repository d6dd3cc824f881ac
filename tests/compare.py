"""Compare a Spark result with its SQL oracle, value by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

# how the two engines name the same type
SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if value is not None else ""


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Human-readable differences; empty when columns, types and all values are the same."""
    result = connection.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_columns = list(sql_types)
    expected = rows_of(sql_columns, result.fetchall())
    actual = rows_of(spark_df.columns, spark_df.collect())
    found = []
    if sorted(sql_columns) != sorted(spark_df.columns):
        found.append(f"columns {sorted(spark_df.columns)} != {sorted(sql_columns)}")
    for name, kind in spark_df.dtypes:
        if SAME_TYPE.get(kind) != sql_types.get(name):
            found.append(f"type of {name}: {kind} != {sql_types.get(name)}")
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows != {len(expected)}")
    unlike = [(a, e) for a, e in zip(actual, expected) if a != e]
    if unlike:
        found.append(f"{len(unlike)} rows differ, first {unlike[0]}")
    if not expected:
        found.append("the oracle is empty")
    return found
