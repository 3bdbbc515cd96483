"""Counts over time: dense matrices, spikes, structural breaks, exposure and peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.operators.ordering import average_rank
from motorspark.operators.reports import value_counts


def counts_by(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Rows per key combination; rows with a missing key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def dense_counts(df: DataFrame, key: str, period: str, min_total: int = 0) -> DataFrame:
    """Zero-filled (key, period, n) over the periods seen for any kept key.

    The axis is one array from a scalar subquery, as long as there are periods, and is exploded
    per key, so neither side is joined with all of the other.
    """
    counts = counts_by(df, [key, period])
    kept = counts.groupBy(key).agg(F.sum("n").alias("_total")).where(F.col("_total") >= min_total).select(key)
    counts = counts.join(kept, key, "left_semi")
    axis = counts.agg(F.collect_set(period)).scalar()
    grid = counts.select(key).distinct().withColumn("_axis", axis).select(key, F.explode("_axis").alias(period))
    return grid.join(counts, [key, period], "left").fillna(0, subset=["n"])


def counts_on_axis(df: DataFrame, key: str, period: str, low: int, high: int, keys: DataFrame | None = None) -> DataFrame:
    """(key, period, n) for every period of a fixed range, zero-filled."""
    counts = counts_by(df, [key, period])
    names = (keys if keys is not None else counts).select(key).distinct()
    grid = names.select(key, F.explode(F.sequence(F.lit(low), F.lit(high))).alias(period))
    return grid.join(counts, [key, period], "left").fillna(0, subset=["n"])


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows per (row, column value), one output column per value, zero-filled."""
    present = df.dropna(subset=[row, column])
    return present.groupBy(row).pivot(column, list(values)).count().fillna(0)


def spikes(dense: DataFrame, key: str, period: str, z: float = 2.0) -> DataFrame:
    """Periods more than ``z`` sample deviations above the key's own mean."""
    own = Window.partitionBy(key)
    scored = dense.withColumn(
        "z_score",
        (F.col("n") - F.avg("n").over(own)) / F.nullif(F.stddev_samp("n").over(own), F.lit(0.0)),
    )
    return scored.where(F.col("z_score") > z)


def structural_breaks(
    dense: DataFrame,
    key: str,
    period: str,
    previous: tuple[int, int],
    recent: tuple[int, int],
    ratio: float = 2.0,
    floor: float = 5.0,
) -> DataFrame:
    """Keys whose recent mean is at least ``ratio`` times the mean of the period before."""
    before, after = F.col("avg_previous"), F.col("avg_recent")
    means = dense.groupBy(key).agg(
        F.avg(F.when(F.col(period).between(*previous), F.col("n"))).alias("avg_previous"),
        F.avg(F.when(F.col(period).between(*recent), F.col("n"))).alias("avg_recent"),
    )
    return means.where((before > 0) & (after >= ratio * before) & (after >= floor)).withColumn(
        "increase_ratio", after / before
    )


def exposure(df: DataFrame, key: str, units: str) -> DataFrame:
    """Recalls, units and units per recall per key, with the average-tie rank by units."""
    totals = (
        df.dropna(subset=[key])
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("recalls"), F.coalesce(F.sum(units), F.lit(0.0)).alias("units_affected"))
        .withColumn("units_per_recall", F.col("units_affected") / F.col("recalls"))
    )
    return average_rank(totals, key, "units_affected", "rank_by_units")


def first_by_rank(df: DataFrame, order: Sequence[Column], k: int, alias: str) -> DataFrame:
    """The first k lines of a summary with their place; the window sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn(alias, F.row_number().over(Window.orderBy(*order)))


def peak(df: DataFrame, period: str) -> DataFrame:
    """Period with the most rows, the earlier one on a tie."""
    counts = value_counts(df, period)
    return counts.agg(F.max_by(period, F.struct(F.col("n"), -F.col(period))).alias("peak_period"), F.max("n").alias("peak_recalls"))


def time_span(df: DataFrame, ts: str, key: str | None = None) -> DataFrame:
    """First and last time, and the longest span of a single key in seconds."""
    if key is None:
        return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    spans = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    seconds = (F.unix_micros("_hi") - F.unix_micros("_lo")) / 1e6
    return spans.agg(F.min("_lo").alias("first"), F.max("_hi").alias("last"), F.max(seconds).alias("longest_seconds"))


def heat_cells(df: DataFrame, row: str, column: str, k: int = 5) -> DataFrame:
    """Counts of the k largest rows by the k largest columns, zero-filled, with the largest cell."""
    rows = value_counts(df, row).orderBy(F.col("n").desc(), row).limit(k).select(row)
    columns = value_counts(df, column).orderBy(F.col("n").desc(), column).limit(k)
    axis = columns.agg(F.collect_list(column)).scalar()
    grid = rows.withColumn("_axis", axis).select(row, F.explode("_axis").alias(column))
    cells = grid.join(counts_by(df, [row, column]), [row, column], "left").fillna(0, subset=["n"])
    return cells.withColumn("largest", cells.agg(F.max("n")).scalar())
