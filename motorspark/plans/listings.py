"""Listings: raw table to clean table, price summaries and price model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import fill_unknown, null_unless
from motorspark.operators import cleaning, pricing, regression, reports, sampling
from motorspark.operators.ordering import quantiles
from motorspark.session import checkpointed
from motorspark.sources.writers import write_document, write_summaries, write_table


@dataclass(frozen=True)
class CleaningPlan:
    """Limits and keys of the cleaning steps; the defaults are the published ones."""

    price: tuple[float, float] = fixed.PRICE_RANGE
    year: tuple[int, int] = fixed.YEAR_RANGE
    odometer_max: float = fixed.ODOMETER_MAX
    near_keys: Sequence[str] = field(default_factory=lambda: list(fixed.NEAR_DUPLICATE_KEYS))
    order: Sequence[str] = ("posting_date",)
    unknown_columns: Sequence[str] = field(default_factory=lambda: list(fixed.UNKNOWN_COLUMNS))
    dropped_columns: Sequence[str] = field(default_factory=lambda: list(fixed.DROPPED_COLUMNS))

    def rules(self) -> list[cleaning.Rule]:
        return [
            ("Price missing or zero", F.col("price").isNotNull()),
            (f"Price outside ${self.price[0]:,} - ${self.price[1]:,}", F.col("price").between(*self.price)),
            (f"Year missing or outside {self.year[0]} - {self.year[1]}", F.col("year").between(*self.year)),
            (f"Odometer missing or outside 0 - {self.odometer_max:,} miles", F.col("odometer").between(0, self.odometer_max)),
        ]

    def prepare(self, raw: DataFrame) -> DataFrame:
        """A price of zero is missing; a missing category is its own value."""
        priced = null_unless(raw, {"price": F.col("price") > 0}).drop(*self.dropped_columns)
        return fill_unknown(priced, [c for c in self.unknown_columns if c in priced.columns])

    def clean(self, raw: DataFrame) -> DataFrame:
        return cleaning.clean(self.prepare(raw), self.rules(), "id", "VIN", self.near_keys, self.order)

    def audit(self, raw: DataFrame) -> DataFrame:
        return cleaning.cleaning_audit(self.prepare(raw), self.rules(), "id", "VIN", self.near_keys, self.order)


@dataclass(frozen=True)
class PriceModel:
    """Fitted model, its test scores and the rows it was tested on."""

    model: regression.Model
    train: regression.Products
    test: regression.Products
    scored: DataFrame

    @property
    def r2(self) -> float:
        return regression.r_squared(self.test, self.model)


def price_model(features: DataFrame, design: regression.Design = regression.PRICE_DESIGN, seed: int = 42) -> PriceModel:
    """Log-price regression on 80 % of the ids, scored on the rest; one pass for both matrices."""
    rows = features.withColumn("log_price", F.log("price")).withColumn("in_train", sampling.in_train("id", seed))
    products = regression.collect_products(regression.product_sums(rows, design, ["in_train"]), ["in_train"])
    model = regression.fit(products[(True,)], design)
    scored = (
        rows.where(~F.col("in_train"))
        .dropna(subset=[*design.numeric, design.target])
        .withColumn("predicted_price", F.exp(model.predicted()))
    )
    return PriceModel(model, products[(True,)], products[(False,)], scored)


def segment_models(features: DataFrame, segment: str = "brand_segment") -> DataFrame:
    """Yearly and mileage effect refitted inside each segment: two features, so grouped covariances give them in closed form.

    A segment without spread in age and mileage has no effects.
    """
    age, miles, price = F.col("vehicle_age").cast("double"), F.col("odometer_10k").cast("double"), F.log("price")
    rows = features.select(segment, age.alias("a"), miles.alias("m"), price.alias("p")).dropna(subset=["a", "m", "p"])
    pairs = [("a", "a"), ("m", "m"), ("a", "m"), ("a", "p"), ("m", "p")]
    sums = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("listings"), *[F.covar_pop(x, y).alias(x + y) for x, y in pairs])
    spread = F.col("aa") * F.col("mm") - F.col("am") * F.col("am")
    per_year = F.try_divide(F.col("ap") * F.col("mm") - F.col("mp") * F.col("am"), spread)
    per_miles = F.try_divide(F.col("mp") * F.col("aa") - F.col("ap") * F.col("am"), spread)
    return sums.select(
        segment, "listings", (F.expm1(per_year) * 100).alias("pct_per_year"), (F.expm1(per_miles) * 100).alias("pct_per_10k_miles")
    )


def price_summaries(clean: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    axes = {
        "odometer": (F.col("odometer_band"), F.col("odometer") < 240000),
        "year": (F.col("year"), F.col("year") >= 1995),
    }
    measures = {"price": "price", "age": "vehicle_age", "odometer": "odometer"}
    return {
        "price_by_segment": pricing.stacked_summary(clean, list(fixed.SEGMENTS), "price"),
        "price_by_segment_lines": pricing.segment_curves(features, axes, fixed.SEGMENTS, "price"),
        "brand_summary": pricing.brand_summary(features, "manufacturer", measures),
        "depreciation_curve": pricing.depreciation(features, "vehicle_age", "price"),
        "depreciation_by_brand": pricing.depreciation_by(features, "manufacturer", "vehicle_age", "price"),
        "brand_price_by_era": pricing.brand_era_boxes(features, "manufacturer", "year", "price"),
        "histogram": pricing.histogram(clean, F.col("price"), 40, *fixed.PRICE_RANGE, log=True),
    }


#: Order of the published tables, "-" for descending; the others go by their first column.
ORDERS = {
    "cleaning_audit": ["step_no"],
    "missingness": ["-missing_pct", "column"],
    "price_by_segment": ["segment", "-median_price"],
    "brand_summary": ["-median_price", "manufacturer"],
    "schema_report": [],
    "price_model_effects": [],
    "price_model_importance": ["-r2_drop"],
    "price_model_error_by_price": [],
}


def model_score(fitted: PriceModel) -> DataFrame:
    """One line: rows fitted and tested on, explained variance and median error on the test rows."""
    test_rows = int(fitted.test.block([regression.INTERCEPT], [regression.INTERCEPT])[0, 0])
    errors = regression.median_error_pct(fitted.scored, "price", "predicted_price", "median_pct_error")
    return errors.select(
        F.lit(fitted.model.train_rows).cast("long").alias("train_rows"),
        F.lit(test_rows).cast("long").alias("test_rows"),
        F.lit(fitted.r2).alias("r2"),
        "median_pct_error",
    )


def listing_totals(clean: DataFrame, reference_year: int, price: str = "price", year: str = "year", odometer: str = "odometer") -> DataFrame:
    """One line: listings, reference year, and the median price, age and odometer of all listings."""
    measures = {"median_price": F.col(price), "median_age": F.lit(reference_year) - F.col(year), "median_odometer": F.col(odometer)}
    lines = clean.agg(F.count(F.lit(1)).alias("listings"), F.lit(reference_year).alias("reference_year"))
    for name, measure in measures.items():
        lines = lines.withColumn(name, quantiles(clean.select(measure.cast("double").alias("_v")), [], "_v", {name: 0.5}).scalar())
    return lines


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order, for the schema report."""
    return df.orderBy(*order).limit(n)


def run(raw: DataFrame, out: str, plan: CleaningPlan | None = None, reference_year: int = 2021) -> DataFrame:
    """Cleans, writes the clean table, and writes every price summary; returns the clean table."""
    plan = plan or CleaningPlan()
    spark = raw.sparkSession
    priced = null_unless(raw, {"price": F.col("price") > 0})
    tables = {
        "missingness": reports.missingness(priced, fixed.MISSING_DECISIONS, fixed.COMPLETE_DECISION),
        "cleaning_audit": plan.audit(raw),
        "schema_report": reports.schema_profile(raw),
        "schema_first_rows": first_rows(raw, ["id"]),
    }
    write_table(plan.clean(raw), out, "usedcars_clean")
    clean = spark.read.parquet(f"{out}/usedcars_clean")
    # Only the short model list is written out; the features are cheap columns of the clean table.
    features = pricing.price_features(clean, reference_year, top=checkpointed(pricing.top_models(clean)))
    tables |= price_summaries(clean, features)
    fitted = price_model(features)
    effects = regression.effects(fitted.model, regression.NUMERIC_LABELS, fixed.FEATURE_GROUP_NAMES)
    importance = regression.group_importance(
        fitted.train, fitted.test, fitted.model.design,
        {**{k: v[0] for k, v in regression.NUMERIC_LABELS.items()}, **fixed.FEATURE_GROUP_NAMES},
    )
    tables |= {
        "price_model_effects": spark.createDataFrame(effects, "`group` string, label string, pct_effect double, coefficient double"),
        "price_model_importance": spark.createDataFrame(importance, "feature_group string, r2_without double, r2_drop double"),
        "price_model_error_by_price": regression.error_by_band(fitted.scored, "price", "predicted_price"),
        "price_model_robustness": segment_models(features),
        "price_model_score": model_score(fitted),
        "listing_totals": listing_totals(clean, reference_year),
    }
    write_summaries(tables, f"{out}/tables", ORDERS)
    write_document(f"{out}/documents", "cleaning", {k: tables[k] for k in ("cleaning_audit", "missingness")}, ORDERS)
    write_document(
        f"{out}/documents", "pricing",
        {k: t for k, t in tables.items() if k not in ("cleaning_audit", "missingness", "price_by_segment_lines")},
        ORDERS,
    )
    return clean
