"""Runs a query in Spark and its SQL in DuckDB and compares columns, rows and values."""

from __future__ import annotations

import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.6f}"
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, connection, sql: str, shown: int = 3) -> list[str]:
    ours = table(spark_df.columns, spark_df.collect())
    result = connection.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    found = []
    if len(ours[1]) != len(theirs[1]):
        found.append(f"rows {len(ours[1])} != {len(theirs[1])}")
    if ours[1] != theirs[1]:
        left, right = set(ours[1]), set(theirs[1])
        found += [f"{ours[0]}", f"only ours {sorted(left - right)[:shown]}", f"only SQL {sorted(right - left)[:shown]}"]
    return found
