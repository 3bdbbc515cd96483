"""Price summaries: segments, curves, brands, boxes, depreciation and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import band, bin_number, cut, holds
from motorspark.operators.ordering import QUARTILES, quantiles
from motorspark.operators.reports import top_k
from motorspark.session import checkpointed


def stacked_summary(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Rows and median per value of several columns, stacked; one aggregation for all columns."""
    pairs = [F.struct(F.lit(c).alias("segment"), F.col(c).alias("value")) for c in columns]
    long = df.select(F.col(value).alias("_v"), F.inline(F.array(*pairs))).where("value is not null")
    return quantiles(long, ["segment", "value"], "_v", {"median_price": 0.5}, "listings")


def segment_curves(
    df: DataFrame,
    axes: dict[str, tuple[Column, Column]],
    segments: dict[str, list[str]],
    value: str,
    min_rows: int = 150,
) -> DataFrame:
    """Median price along each axis for each segment category; thin points are left out.

    ``axes`` maps a name to (x value, range condition).
    """
    points = F.array(
        *[
            F.struct(
                F.lit(axis).alias("x_axis"),
                F.when(in_range, x).cast("double").alias("x_value"),
                F.lit(segment).alias("segment"),
                F.when(F.col(segment).isin(categories), F.col(segment)).alias("category"),
            )
            for axis, (x, in_range) in axes.items()
            for segment, categories in segments.items()
        ]
    )
    long = df.select(F.col(value).alias("_v"), F.inline(points)).where("x_value is not null and category is not null")
    keys = ["x_axis", "x_value", "segment", "category"]
    return quantiles(long, keys, "_v", QUARTILES, "listings").where(F.col("listings") >= min_rows)


def brand_summary(df: DataFrame, brand: str, measures: dict[str, str], min_rows: int = 500, unknown: str = "unknown") -> DataFrame:
    """Price quartiles and medians of further measures per brand, from one pass over all measures."""
    price = next(iter(measures.values()))
    pairs = [F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("v")) for name, c in measures.items()]
    long = df.where(F.col(brand).isNotNull() & (F.col(brand) != unknown)).select(brand, F.inline(F.array(*pairs)))
    per_measure = quantiles(long, [brand, "measure"], "v", QUARTILES, "listings")
    wide = per_measure.groupBy(brand).agg(
        *[F.max(F.when(F.col("measure") == next(iter(measures)), F.col(c))).alias(c) for c in ("listings", *QUARTILES)],
        *[
            F.max(F.when(F.col("measure") == name, F.col("median_price"))).alias(f"median_{name}")
            for name in list(measures)[1:]
        ],
    )
    return wide.withColumn("iqr", F.col("q75") - F.col("q25")).where(F.col("listings") >= min_rows)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5, weight: str | None = None) -> DataFrame:
    """Quartiles and the outermost values within ``reach`` times the quartile distance."""
    present = df.dropna(subset=[*keys, value])
    boxes = quantiles(present, keys, value, QUARTILES, "listings", weight=weight)
    distinct_values = present.select(*keys, value).distinct()
    spread = (F.col("q75") - F.col("q25")) * reach
    inside = F.col(value).between(F.col("q25") - spread, F.col("q75") + spread)
    return (
        distinct_values.join(boxes, list(keys))
        .where(inside)
        .groupBy(*keys, "listings", *QUARTILES)
        .agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    )


def brand_era_boxes(
    df: DataFrame, brand: str, year: str, value: str,
    edges: Sequence[int] = fixed.ERA_EDGES, labels: Sequence[str] = fixed.ERA_LABELS,
    k: int = 10, unknown: str = "unknown",
) -> DataFrame:
    """Box statistics by era of the k most listed brands (at most k rows are broadcast); rows are counted once for both."""
    counts = checkpointed(df.groupBy(brand, year, value).agg(F.count(F.lit(1)).alias("_n")))
    top = most_listed(counts, brand, k, unknown)
    eras = counts.join(F.broadcast(top), brand, "left_semi").withColumn("era", cut(F.col(year), edges, labels))
    return box_stats(eras, [brand, "era"], value, weight="_n")


def most_listed(counts: DataFrame, key: str, k: int, unknown: str) -> DataFrame:
    """The k keys with the most rows in a table of counts ``_n``, ties to the smaller key."""
    known = counts.where(F.col(key).isNotNull() & (F.col(key) != unknown))
    return known.groupBy(key).agg(F.sum("_n").alias("_n")).orderBy(F.col("_n").desc(), key).limit(k).select(key)


def depreciation(df: DataFrame, age: str, value: str, max_age: int = 25) -> DataFrame:
    return quantiles(df.where(F.col(age) <= max_age), [age], value, QUARTILES, "listings")


def depreciation_by(
    df: DataFrame, key: str, age: str, value: str,
    k: int = 10, min_rows: int = 30, max_age: int = 25, everything: str = "All brands", unknown: str = "unknown",
) -> DataFrame:
    """Median price by age for the k most listed brands and for all rows.

    Rows are counted once; each counts for its own brand, when that is a listed one, and for all.
    """
    counts = checkpointed(df.groupBy(key, age, value).agg(F.count(F.lit(1)).alias("_n")))
    top = most_listed(counts, key, k, unknown).select(F.col(key).alias("_top"))
    series = F.when(F.col("_top").isNotNull(), F.array(F.lit(everything), F.col("_top"))).otherwise(
        F.array(F.lit(everything))
    )
    long = (
        counts.where(F.col(age) <= max_age)
        .join(F.broadcast(top), F.col(key) == F.col("_top"), "left")
        .select(F.explode(series).alias("series"), age, value, "_n")
    )
    curves = quantiles(long, ["series", age], value, {"median_price": 0.5}, "listings", weight="_n")
    return curves.where((F.col("series") == everything) | (F.col("listings") >= min_rows))


def dense_axis(df: DataFrame, key: str, axis: str, low: int, high: int) -> DataFrame:
    """Every whole axis value per key; values without a line stay missing."""
    grid = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(low), F.lit(high))).alias(axis))
    return grid.join(df, [key, axis], "left")


def histogram(
    df: DataFrame, column: Column, bins: int, low: float | None = None, high: float | None = None, log: bool = False
) -> DataFrame:
    """Rows per equal-width bin, empty bins shown; without limits the bins span the data."""
    values = df.select((F.log10(column) if log else column.cast("double")).alias("_v"))
    if low is None or high is None:
        ends = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
        # A single value gets a bin range of width one around it.
        half = F.when(ends["lo"] == ends["hi"], 0.5).otherwise(0.0)
        values = values.withColumns({"_lo": ends["lo"] - half, "_hi": ends["hi"] + half})
    else:
        limits = [F.log10(F.lit(float(x))) if log else F.lit(float(x)) for x in (low, high)]
        values = values.withColumns({"_lo": limits[0], "_hi": limits[1]})
    counts = (
        values.select(bin_number(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("bin"), "_lo", "_hi")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )
    axis = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    edges = counts.agg(F.struct(F.max("_lo").alias("lo"), F.max("_hi").alias("hi"))).scalar()
    dense = axis.join(counts.select("bin", "n"), "bin", "left").withColumns({"_lo": edges["lo"], "_hi": edges["hi"]})
    left = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins
    right = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / bins
    if log:
        left, right = F.pow(F.lit(10.0), left), F.pow(F.lit(10.0), right)
    return dense.select(
        "bin", left.alias("bin_from"), right.alias("bin_to"), F.coalesce("n", F.lit(0)).cast("long").alias("listings")
    )


def top_models(df: DataFrame, k: int = 20, unknown: str = "unknown") -> DataFrame:
    return top_k(df, "model", k, [unknown]).select("model")


def price_features(
    df: DataFrame,
    reference_year: int = 2021,
    luxury: Sequence[str] = fixed.LUXURY_BRANDS,
    k: int = 20,
    top: DataFrame | None = None,
) -> DataFrame:
    """Age at listing, miles per year, brand segment and the k most listed models.

    ``top`` is the list of kept models where it is already at hand.
    """
    top = (top_models(df, k) if top is None else top).select(F.col("model").alias("_top"))
    age = F.greatest(F.lit(reference_year) - F.col("year"), F.lit(0))
    return (
        df.withColumn("vehicle_age", age)
        .withColumn("miles_per_year", F.col("odometer") / F.greatest(F.col("vehicle_age"), F.lit(1)))
        .withColumn("brand_segment", F.when(holds(F.col("manufacturer").isin(list(luxury))), "Luxury").otherwise("Standard"))
        .join(F.broadcast(top), F.col("model") == F.col("_top"), "left")
        .withColumn("model_grouped", F.coalesce("_top", F.lit("Other")))
        .withColumn("odometer_10k", F.col("odometer") / 10000)
        .withColumn("odometer_band", band(F.col("odometer"), 20000))
        .drop("_top")
    )


def model_coverage(features: DataFrame) -> DataFrame:
    """Share of rows whose model is one of the kept ones, and the number of model spellings."""
    spellings = features.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_grouped") != "Other").alias("kept")
    )
    return spellings.agg(
        F.sum("n").alias("listings"),
        (F.sum("kept") * 100.0 / F.sum("n")).alias("covered_pct"),
        F.count("model").alias("models"),
    )

