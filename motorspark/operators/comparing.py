"""Two sources of the same facts: comparison flags, reports, rules and decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.text import classify_contains
from motorspark.functions.values import holds, map_values, replace_values
from motorspark.operators.ordering import quantiles


@dataclass(frozen=True)
class Field:
    """One compared fact: its label, the two columns, and when two values disagree."""

    label: str
    ours: str
    theirs: str
    conflict: Callable[[Column, Column], Column] = lambda a, b: a != b


def drive_conflict(ours: Column, theirs: Column) -> Column:
    """Two-wheel drive agrees with front and with rear drive."""
    return (ours != theirs) & ~((theirs == "2wd") & ours.isin("fwd", "rwd"))


FIELDS = [
    Field("Manufacturer", "make_listing", "make_api"),
    Field("Model year", "year", "API_Year"),
    Field("Drive type", "drive_listing", "drive_api", drive_conflict),
    Field("Fuel type", "fuel_listing", "fuel_api"),
]


def align(df: DataFrame, fuels: dict[str, str] = fixed.FUEL_NAMES, aliases: dict[str, str] = fixed.MAKE_ALIASES) -> DataFrame:
    """Both sources in the same vocabulary, and the decode status."""
    make = replace_values(F.replace(F.col("manufacturer"), F.lit("-"), F.lit(" ")), aliases)
    api_make = replace_values(F.replace(F.lower("API_Make"), F.lit("-"), F.lit(" ")), aliases)
    drive = F.nullif(F.col("drive"), F.lit("unknown"))
    return (
        df.withColumn("Status", F.coalesce("Status", F.lit("Failed")))
        .withColumn("decoded", F.col("Status") == "Success")
        .withColumn("make_listing", F.nullif(make, F.lit("unknown")))
        .withColumn("make_api", api_make)
        .withColumn("drive_api", classify_contains(F.col("API_Drive"), fixed.DRIVE_TERMS))
        .withColumn("drive_listing", drive)
        .withColumn("fuel_api", map_values(F.col("API_Fuel"), fuels))
        .withColumn("fuel_listing", F.when(F.col("fuel").isin(list(dict.fromkeys(fuels.values()))), F.col("fuel")))
        .withColumn("drive_enriched", F.coalesce("drive_listing", "drive_api"))
    )


def compare_sources(df: DataFrame, fields: Sequence[Field], ok: str) -> DataFrame:
    """Per field: compared, filled (only the other source has a value) and conflict."""
    added = {}
    for field in fields:
        ours, theirs = F.col(field.ours), F.col(field.theirs)
        both = F.col(ok) & ours.isNotNull() & theirs.isNotNull()
        added[f"both_{field.ours}"] = both
        added[f"filled_{field.ours}"] = F.col(ok) & ours.isNull() & theirs.isNotNull()
        added[f"conflict_{field.ours}"] = both & holds(field.conflict(ours, theirs))
    return df.withColumns(added)


def comparison_report(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    totals = df.agg(
        *[
            F.count_if(f"{kind}_{field.ours}").alias(f"_{kind}{i}")
            for i, field in enumerate(fields)
            for kind in ("both", "filled", "conflict")
        ]
    )
    lines = [
        F.struct(
            F.lit(field.label).alias("field"),
            F.col(f"_both{i}").alias("compared"),
            F.col(f"_filled{i}").alias("gaps_filled"),
            F.col(f"_conflict{i}").alias("conflicts"),
            (F.col(f"_conflict{i}") * 100.0 / F.greatest(F.col(f"_both{i}"), F.lit(1))).alias("conflict_pct"),
        )
        for i, field in enumerate(fields)
    ]
    return totals.select(F.inline(F.array(*lines)))


def conflict_samples(df: DataFrame, fields: Sequence[Field], key: str, n: int = 5) -> DataFrame:
    """First n conflicts per field by key."""
    found = [
        F.when(
            F.col(f"conflict_{field.ours}"),
            F.struct(
                F.lit(field.label).alias("field"),
                F.col(field.ours).cast("string").alias("listing_value"),
                F.col(field.theirs).cast("string").alias("api_value"),
            ),
        )
        for field in fields
    ]
    rows = df.select(key, F.inline(F.array_compact(F.array(*found))))
    first = Window.partitionBy("field").orderBy(key)
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)


def before_after(df: DataFrame, before: str, after: str, value: str, unknown: str = "unknown") -> DataFrame:
    """Rows and median per category under two labellings; categories of either side are shown.

    Every row is offered once per labelling, so both sides come from one aggregation.
    """
    sides = F.array(
        *[
            F.struct(F.lit(tag).alias("side"), F.coalesce(column, F.lit(unknown)).alias("drive"))
            for tag, column in (("before", before), ("after", after))
        ]
    )
    both = df.select(F.col(value).alias("_v"), F.inline(sides))
    summary = quantiles(both, ["side", "drive"], "_v", {"median": 0.5}, "n")

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return summary.groupBy("drive").agg(
        F.coalesce(of("before", "n"), F.lit(0)).alias("listings_before"),
        of("before", "median").alias("median_price_before"),
        of("after", "n").alias("listings_after"),
        of("after", "median").alias("median_price_after"),
    )


def spec_rules(current_year: Column | int, fuels: Sequence[str] = ("gas", "diesel", "hybrid"), electric: str = "electric") -> dict[str, Column]:
    """Cross-field rules on a listing and its decoded specification; true means violated."""
    latest = F.lit(current_year) if isinstance(current_year, int) else current_year
    engine, api_year = F.col("API_Engine"), F.col("API_Year")
    return {
        "Electric vehicle with an engine displacement": holds((F.col("fuel") == electric) & (engine > 0)),
        "Combustion vehicle without an engine displacement": holds(
            F.col("decoded") & F.col("fuel").isin(list(fuels)) & ~holds(engine > 0)
        ),
        "Model year out of range": holds(api_year.isNotNull() & ~api_year.between(F.lit(1981), latest + 1)),
        "Pickup without a drivetrain": holds(F.col("API_Body").contains("Pickup") & F.col("API_Drive").isNull()),
        "Listed year more than 1 year off the decoded year": holds(
            F.col("decoded") & (F.abs(F.col("year") - api_year) > 1)
        ),
    }


def rule_masks(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    names = {rule: f"rule_{i}" for i, rule in enumerate(rules)}
    return df.withColumns({names[rule]: mask for rule, mask in rules.items()}), names


def taxonomy_checks() -> list[tuple[str, str, Column]]:
    decoded = F.col("decoded")
    return [
        ("Listing error", "Manufacturer conflict", F.col("conflict_make_listing")),
        ("Listing error", "Model year conflict", F.col("conflict_year")),
        ("Listing error", "Drive type conflict", F.col("conflict_drive_listing")),
        ("Listing error", "Fuel type conflict", F.col("conflict_fuel_listing")),
        ("Decoder missingness", "VIN not decoded", ~decoded),
        ("Decoder missingness", "Missing engine", decoded & F.col("API_Engine").isNull()),
        ("Decoder missingness", "Missing drivetrain", decoded & F.col("API_Drive").isNull()),
        ("Decoder missingness", "Missing body class", decoded & F.col("API_Body").isNull()),
    ]


def decide(df: DataFrame) -> DataFrame:
    """Adds ``action`` and ``year_original``; every year conflict takes the decoded year."""
    action = (
        F.when(~F.col("decoded"), "Drop")
        .when(F.col("conflict_make_listing"), "Flag")
        .when(F.col("conflict_year"), "Correct")
        .otherwise("Keep")
    )
    return (
        df.withColumn("action", action)
        .withColumn("year_original", F.col("year"))
        .withColumn("year", F.when(F.col("conflict_year"), F.col("API_Year")).otherwise(F.col("year")).cast("double"))
    )
