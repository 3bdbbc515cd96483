"""Count, share, profile and rule reports, each from one pass over its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.functions.values import holds
from motorspark.operators.ordering import quantiles


def value_counts(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Rows per value, missing left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def with_share(df: DataFrame, count: str, pct: str) -> DataFrame:
    """Share of each line in the sum of all lines, for summary tables."""
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(pct, F.col(count) * 100.0 / total)


def top_k(df: DataFrame, column: str, k: int, exclude: Sequence[str] = (), count: str = "n") -> DataFrame:
    """The k most frequent values; equal counts go by value."""
    kept = df.where(~F.col(column).isin(list(exclude))) if exclude else df
    return value_counts(kept, column, count).orderBy(F.col(count).desc(), F.col(column)).limit(k)


def mode_by(df: DataFrame, key: str, column: str, alias: str) -> DataFrame:
    """Most frequent value per key; equal counts go to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("value")))
    return counts.groupBy(key).agg(best.alias("_best")).select(key, F.col("_best.value").alias(alias))


def count_report(
    df: DataFrame,
    checks: Sequence[tuple[str, Column]],
    label: str,
    count: str,
    pct: str,
    of: Column | None = None,
) -> DataFrame:
    """Rows per condition and their share of all rows, or of the rows where ``of`` holds."""
    whole = F.count(F.lit(1)) if of is None else F.count_if(of)
    totals = df.agg(
        whole.alias("_whole"),
        *[F.count_if(holds(condition)).alias(f"_c{i}") for i, (_, condition) in enumerate(checks)],
    )
    lines = [
        F.struct(
            F.lit(name).alias(label),
            F.col(f"_c{i}").alias(count),
            (F.col(f"_c{i}") * 100.0 / F.nullif(F.col("_whole"), F.lit(0))).alias(pct),
        )
        for i, (name, _) in enumerate(checks)
    ]
    return totals.select(F.inline(F.array(*lines)))


def _lines(totals: DataFrame, rows: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """A one-row table of totals as one line per struct."""
    return totals.select(
        F.inline(F.array(*[F.struct(*[c.alias(name) for name, c in row]) for row in rows]))
    )


def missingness(df: DataFrame, decisions: dict[str, str], complete: str) -> DataFrame:
    totals = df.agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    )
    return _lines(
        totals,
        [
            [
                ("column", F.lit(c)),
                ("missing_pct", F.col(f"_m{i}") * 100),
                ("decision", F.lit(decisions.get(c, complete))),
            ]
            for i, c in enumerate(df.columns)
        ],
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or numeric_columns(df))
    totals = df.agg(
        *[f(c).cast("double").alias(f"_{tag}{i}") for i, c in enumerate(names) for tag, f in (("lo", F.min), ("hi", F.max))]
    )
    return _lines(
        totals,
        [[("column", F.lit(c)), ("min", F.col(f"_lo{i}")), ("max", F.col(f"_hi{i}"))] for i, c in enumerate(names)],
    )


def _long(df: DataFrame, columns: Sequence[str], name: str, value: str, dtype: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): column name and value."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast(dtype).alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def schema_profile(df: DataFrame) -> DataFrame:
    """Type, rows and filled rows of every column."""
    totals = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(f"_f{i}") for i, c in enumerate(df.columns)])
    return _lines(
        totals,
        [
            [
                ("column", F.lit(field.name)),
                ("type", F.lit(field.dataType.simpleString())),
                ("rows", F.col("_all")),
                ("filled", F.col(f"_f{i}")),
            ]
            for i, field in enumerate(df.schema.fields)
        ],
    )


def category_profile(df: DataFrame, columns: Sequence[str] | None = None, max_values: int = 15) -> DataFrame:
    """Distinct count per text column, and the values where there are fewer than ``max_values``."""
    names = list(columns or string_columns(df))
    pairs = _long(df, names, "column", "value", "string").where("value is not null").distinct()
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    # The row_number filter lets each task keep at most max_values rows per column.
    window = Window.partitionBy("column").orderBy("value")
    shown = (
        pairs.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") < max_values)
        .groupBy("column")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("value"))).alias("_values"))
    )
    return counts.join(shown, "column").select(
        "column", "n_unique", F.when(F.col("n_unique") < max_values, F.col("_values")).alias("sample_values")
    )


def describe_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    long = _long(df, columns, "column", "value", "double").where("value is not null")
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarters = quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quarters, "column")


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count per column."""
    counts = (
        _long(df, columns, "column", "value", "string")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return (
        counts.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_unique"), best.alias("_best"))
        .select("column", "count", "n_unique", F.col("_best.value").alias("top"), (-F.col("_best.n")).alias("freq"))
    )


def adjusted_skewness(column: Column) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def signal_ranges(df: DataFrame, signals: dict[str, str]) -> DataFrame:
    """Minimum, median, 99 % point, maximum and missing count per labelled signal."""
    long = _long(df, list(signals), "name", "value", "double")
    ends = long.groupBy("name").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )
    points = quantiles(long, ["name"], "value", {"p50": 0.5, "p99": 0.99})
    names = F.create_map(*[F.lit(x) for item in signals.items() for x in item])
    return ends.join(points, "name", "left").select(
        F.try_element_at(names, F.col("name")).alias("signal"), "min", "p50", "p99", "max", "missing"
    )


def violation_report(df: DataFrame, masks: dict[str, str], example: str) -> DataFrame:
    """Rows per rule-mask column, their share, and the smallest example id (empty when none)."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(m)).alias(f"_n{i}") for i, m in enumerate(masks.values())],
        *[F.min(F.when(F.col(m), F.col(example))).alias(f"_e{i}") for i, m in enumerate(masks.values())],
    )
    return _lines(
        totals,
        [
            [
                ("rule", F.lit(name)),
                ("violations", F.col(f"_n{i}")),
                ("violation_pct", F.col(f"_n{i}") * 100.0 / F.nullif(F.col("_all"), F.lit(0))),
                ("example_vin", F.coalesce(F.col(f"_e{i}"), F.lit(""))),
            ]
            for i, name in enumerate(masks)
        ],
    )


def share_by(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], count: str) -> DataFrame:
    """Rows, and the mean of each measure, per group with a key."""
    kept = df.dropna(subset=list(keys))
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), *[F.avg(c).alias(name) for name, c in measures.items()]
    )


def validate_flags(
    df: DataFrame, flags: dict[str, Column], scored: Column, rest: str, applies: Column
) -> DataFrame:
    """Per flag, and for all rows, how many rows apply and which share is scored high."""
    totals = df.where(applies).agg(
        *[F.count_if(holds(c)).alias(f"_n{i}") for i, c in enumerate(flags.values())],
        *[F.avg(F.when(holds(c), scored.cast("int"))).alias(f"_s{i}") for i, c in enumerate(flags.values())],
        F.count(F.lit(1)).alias("_all"),
        F.avg(scored.cast("int")).alias("_share"),
    )
    rows = [
        [("group", F.lit(name)), ("recalls", F.col(f"_n{i}")), ("share_scored_high", F.col(f"_s{i}") * 100)]
        for i, name in enumerate(flags)
    ]
    rows.append([("group", F.lit(rest)), ("recalls", F.col("_all")), ("share_scored_high", F.col("_share") * 100)])
    return _lines(totals, rows)
