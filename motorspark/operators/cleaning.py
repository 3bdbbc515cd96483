"""Validity rules, de-duplication and the audit that adds up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions.values import holds

Rule = tuple[str, Column]


def first_broken(rules: Sequence[Rule]) -> Column:
    """Place of the first rule a row breaks; missing for a valid row."""
    return F.coalesce(*[F.when(~holds(valid), F.lit(i)) for i, (_, valid) in enumerate(rules)])


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that keep every rule, as plain filters that reach the scan where a column is stored."""
    for _, valid in rules:
        df = df.where(valid)
    return df


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Missing keys are equal to each other.

    The filter on row_number lets Spark cut every key to one row per map task before the
    shuffle, so a key that holds a third of the rows costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def latest_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    """The order columns, then every other column, so that no tie is left open."""
    return [*order, *[c for c in df.columns if c not in order]]


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key; rows without a key are all kept: each has a number of its own for a key. One pass over the input."""
    columns = [F.col(c).desc_nulls_last() for c in latest_order(df, order)]
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return keep_first(df.withColumn("_own", own), [key, "_own"], columns).drop("_own")


def _repost_keys(vin: str, near_keys: Sequence[str]) -> dict[str, Column]:
    """One key for both repost rules: the VIN where there is one, else the near-duplicate columns."""
    near = {f"_near_{k}": F.when(F.col(vin).isNull(), F.col(k)) for k in near_keys}
    return {"_vin": F.col(vin), **near}


def clean(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str,
    vin: str,
    near_keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Valid rows, one per id, then one per VIN and, without a VIN, one per near-duplicate key."""
    places = [F.col(c).desc_nulls_last() for c in latest_order(df, [*order, vin, *near_keys])]
    unique = keep_first(apply_rules(df, rules), [key], places)
    return keep_first(unique, list(_repost_keys(vin, near_keys).values()), [F.col(order[0]).desc_nulls_last(), F.col(key).desc()])


def cleaning_audit(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str,
    vin: str,
    near_keys: Sequence[str],
    order: Sequence[str],
    step_names: tuple[str, str, str] = (
        "Exact duplicate rows / duplicate ad IDs",
        "Same vehicle listed again (duplicate VIN)",
        "Same ad reposted without a VIN (same car details and price)",
    ),
) -> DataFrame:
    """Rows removed and remaining per cleaning step, from one scan.

    Two chained aggregates carry row counts along: broken rows collapse to one group per rule,
    valid rows to one per id and then to one per repost key.
    """
    broken = first_broken(rules)
    shown = list(dict.fromkeys([*order, vin, *near_keys]))
    by_id = (
        df.withColumn("_rule", broken)
        .groupBy("_rule", F.when(F.col("_rule").isNull(), F.col(key)).alias("_id"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max(F.when(F.col("_rule").isNull(), F.struct(*shown))).alias("_best"),
        )
        .select("_rule", "_rows", "_best.*")
    )
    by_vehicle = by_id.groupBy(
        "_rule", *[column.alias(name) for name, column in _repost_keys(vin, near_keys).items()]
    ).agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_ids"))
    totals = by_vehicle.groupBy().agg(
        F.sum("_rows").alias("total"),
        *[F.sum(F.when(F.col("_rule") == i, F.col("_rows"))).alias(f"_r{i}") for i in range(len(rules))],
        F.sum(F.when(F.col("_rule").isNull(), F.col("_rows") - F.col("_ids"))).alias("_same_id"),
        F.sum(F.when(F.col("_rule").isNull() & F.col("_vin").isNotNull(), F.col("_ids") - 1)).alias("_same_vin"),
        F.sum(F.when(F.col("_rule").isNull() & F.col("_vin").isNull(), F.col("_ids") - 1)).alias("_near"),
    )
    names = [name for name, _ in rules] + list(step_names)
    columns = [f"_r{i}" for i in range(len(rules))] + ["_same_id", "_same_vin", "_near"]
    return audit_steps(totals, list(zip(names, columns)), "total")


def audit_steps(totals: DataFrame, steps: Sequence[tuple[str, str]], total: str) -> DataFrame:
    """A one-row table of removed counts as one line per step, with running rest and percentage."""
    lines, removed = [], F.lit(0).cast("long")
    for place, (name, column) in enumerate(steps, start=1):
        count = F.coalesce(F.col(column), F.lit(0)).cast("long")
        removed = removed + count
        lines.append(
            F.struct(
                F.lit(place).alias("step_no"),
                F.lit(name).alias("step"),
                count.alias("rows_removed"),
                (F.col(total) - removed).alias("rows_remaining"),
                (count * 100.0 / F.col(total)).alias("pct_of_original"),
            )
        )
    return totals.select(F.inline(F.array(*lines)))
