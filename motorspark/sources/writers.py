"""Sinks for tables, summaries and nested result documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")


def in_order(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Sorted by range, so that files follow each other and a table of any length stays parallel.

    A minus sign before a name is descending. Without an order the first column is one; an empty order leaves a report's
    lines as they come.
    """
    order = df.columns[:1] if order is None else order
    columns = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    return df.orderBy(*columns) if columns else df


def write_summary(df: DataFrame, folder: str, name: str, order: Sequence[str] | None = None) -> None:
    """A summary table as CSV in its order; a short one is one file."""
    in_order(df, order).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_summaries(tables: dict[str, DataFrame], folder: str, orders: dict[str, Sequence[str]]) -> None:
    for name, table in tables.items():
        write_summary(table, folder, name, orders.get(name))


def as_lists(df: DataFrame, order: str, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Each column as a list in the given order, for the whole summary or per key."""
    grouped = df.groupBy(key) if key else df.groupBy()
    items = grouped.agg(F.sort_array(F.collect_list(F.struct(order, *[F.col(c).alias(f"_{c}") for c in columns]))).alias("_items"))
    lists: list[Column] = [F.col(f"_items._{c}").alias(c) for c in columns]
    return items.select(*([key] if key else []), *lists)


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """The lines of all parts as (part, line): each line is a JSON object with missing values as null."""
    lines = [
        df.select(F.lit(name).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, lines)


def write_document(
    folder: str, name: str, parts: dict[str, DataFrame], orders: dict[str, Sequence[str]] | None = None
) -> None:
    """Each part as JSON, one line per record, in its order; missing values are written as null."""
    for part, df in parts.items():
        in_order(df, (orders or {}).get(part)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}/{part}")
