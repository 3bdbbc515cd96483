"""Every operator as a query over the driver tables.

The views in ``views`` stand in for the vehicle files; limits and word lists are tuned to them
and passed as parameters. Doubles are rounded to six digits so that the order of additions
does not show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark import views
from motorspark.functions import fixed_values as fixed
from motorspark.functions.text import (
    announcing_sentence, classify_regex, first_token, model_years, normalize_company, severity, short_name,
)
from motorspark.functions.values import share_bucket
from motorspark.operators import (
    cleaning, comparing, joins, linking, pricing, regression, reports, sampling, timeline, topics, trend,
)
from motorspark.operators.timeline import Series
from motorspark.plans import listings as listings_plan
from motorspark.plans import recalls as recall_plan
from motorspark.plans import specs as spec_plan
from motorspark.plans import telematics as telematics_plan
from motorspark.plans.listings import CleaningPlan, price_model, segment_models
from motorspark.session import checkpointed
from motorspark.sources.readers import decoded_status, reply_items, spec_items
from motorspark.sources.writers import as_lists, document

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CLEANING = CleaningPlan(
    price=(2000, 90000),
    year=(1996, 2001),
    odometer_max=384000,
    near_keys=["manufacturer", "model", "year"],
    order=["posting_date", "price", "odometer"],
    unknown_columns=["drive", "type", "manufacturer", "model", "fuel", "transmission"],
    dropped_columns=[],
)
LUXURY = ["Brand#1", "Brand#3", "Brand#5", "Brand#7", "Brand#9"]
REFERENCE_YEAR = 2001
SEGMENTS = {"fuel": ["A", "N"], "transmission": ["F", "O"], "drive": ["fwd", "rwd", "4wd"]}
ERA_EDGES = [1995, 1997, 1999, 2001]
ERA_LABELS = ["1996-1997", "1998-1999", "2000-2001"]
DESIGN = regression.Design(
    "log_price",
    ["vehicle_age", "odometer_10k"],
    {"type": "ECONOMY", "fuel": "A", "transmission": "F", "drive": "fwd", "brand_segment": "Standard", "model_grouped": "Other"},
)
GROUPS = {"Group one": "^nation 1", "Group two": "^nation 2|^nation 12", "Group twelve": "^nation 12$"}
BREAK_MONTH = 1998 * 12 + 5
HIGH_TERMS = ["anin", "onnt"]
MEDIUM_TERMS = ["onst", "aner"]
FUELS = {"Gasoline": "A", "Diesel": "N", "Electric": "R"}
STOP_WORDS = ["the", "and", "of", "in", "is", "that", "for", "with", "as", "on", "by", "it", "be", "to", "at", "this"]
SERIES = Series("deviceID", "ts", "event_id")
GAP, STEP, MIN_RUN = 3600, (0, 600), 3


def query(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, sf_dir: six_digits(function(spark, sf_dir))
    return function


def six_digits(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles}) if doubles else df


# --- listings ---


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CLEANING.clean(views.listings(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_features(clean(spark, sf_dir), REFERENCE_YEAR, LUXURY, 20)


def fitted_prices(spark: SparkSession, sf_dir: str) -> listings_plan.PriceModel:
    """The price model on cleaned listings that are written once: the kept models, the sums and the scores all read them."""
    columns = ["id", "price", "year", "odometer", "manufacturer", "model", "type", "fuel", "transmission", "drive"]
    rows = checkpointed(clean(spark, sf_dir).select(*columns))
    return price_model(pricing.price_features(rows, REFERENCE_YEAR, LUXURY, 20), DESIGN)


@query
def rule_audit(spark, sf_dir):
    return CLEANING.audit(views.listings(spark, sf_dir))


@query
def clean_listings(spark, sf_dir):
    return clean(spark, sf_dir)


@query
def latest_per_vin(spark, sf_dir):
    listings = views.listings(spark, sf_dir).select("id", "VIN", "posting_date", "price", "odometer")
    return cleaning.latest_by(listings, "VIN", ["posting_date", "price", "odometer", "id"])


@query
def schema_profile(spark, sf_dir):
    return reports.schema_profile(views.listings(spark, sf_dir))


@query
def category_profile(spark, sf_dir):
    columns = ["manufacturer", "model", "type", "fuel", "transmission", "drive", "VIN", "posting_date"]
    return reports.category_profile(views.listings(spark, sf_dir), columns)


@query
def missingness(spark, sf_dir):
    return reports.missingness(views.listings(spark, sf_dir), fixed.MISSING_DECISIONS, fixed.COMPLETE_DECISION)


@query
def numeric_ranges(spark, sf_dir):
    return reports.numeric_ranges(views.listings(spark, sf_dir), ["price", "year", "odometer", "p_size"])


@query
def describe_price(spark, sf_dir):
    return reports.describe_numbers(clean(spark, sf_dir), ["price", "odometer", "year"])


@query
def describe_text(spark, sf_dir):
    return reports.describe_text(clean(spark, sf_dir), ["manufacturer", "model", "type", "drive"])


@query
def skewness_log(spark, sf_dir):
    price = F.col("price")
    return clean(spark, sf_dir).agg(
        reports.adjusted_skewness(price).alias("raw_skewness"),
        reports.adjusted_skewness(F.log(price)).alias("log_skewness"),
    )


@query
def price_by_segment(spark, sf_dir):
    return pricing.stacked_summary(clean(spark, sf_dir), list(SEGMENTS), "price")


@query
def segment_curves(spark, sf_dir):
    axes = {
        "odometer": (F.col("odometer_band"), F.col("odometer") < 240000),
        "year": (F.col("year"), F.col("year") >= 1997),
    }
    banded = clean(spark, sf_dir).withColumn("odometer_band", pricing.band(F.col("odometer"), 20000))
    return pricing.segment_curves(banded, axes, SEGMENTS, "price", 50)


@query
def brand_summary(spark, sf_dir):
    aged = clean(spark, sf_dir).withColumn("vehicle_age", F.lit(REFERENCE_YEAR) - F.col("year"))
    measures = {"price": "price", "age": "vehicle_age", "odometer": "odometer"}
    return pricing.brand_summary(aged, "manufacturer", measures, 100)


@query
def box_by_brand_era(spark, sf_dir):
    return pricing.brand_era_boxes(clean(spark, sf_dir), "manufacturer", "year", "price", ERA_EDGES, ERA_LABELS)


@query
def depreciation(spark, sf_dir):
    aged = clean(spark, sf_dir).withColumn("vehicle_age", F.lit(REFERENCE_YEAR) - F.col("year"))
    return pricing.depreciation(aged, "vehicle_age", "price", 4)


@query
def depreciation_by_brand(spark, sf_dir):
    aged = clean(spark, sf_dir).withColumn("vehicle_age", F.lit(REFERENCE_YEAR) - F.col("year"))
    curves = pricing.depreciation_by(aged, "manufacturer", "vehicle_age", "price", 10, 30, 4)
    return pricing.dense_axis(curves, "series", "vehicle_age", 0, 6)


@query
def depreciation_lists(spark, sf_dir):
    aged = clean(spark, sf_dir).withColumn("vehicle_age", F.lit(REFERENCE_YEAR) - F.col("year"))
    curves = pricing.depreciation_by(aged, "manufacturer", "vehicle_age", "price", 10, 30, 4)
    lists = as_lists(curves, "vehicle_age", ["vehicle_age", "listings"], "series")
    return lists.select("series", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("vehicle_age", "listings")])


@query
def histogram_raw(spark, sf_dir):
    return pricing.histogram(clean(spark, sf_dir), F.col("price"), 50)


@query
def histogram_log(spark, sf_dir):
    return pricing.histogram(clean(spark, sf_dir), F.col("price"), 40, 2000, 90000, log=True)


@query
def price_features(spark, sf_dir):
    return features(spark, sf_dir).select(
        "id", "vehicle_age", "miles_per_year", "brand_segment", "model_grouped", "odometer_10k"
    )


@query
def top_model_group(spark, sf_dir):
    return pricing.model_coverage(features(spark, sf_dir))


@query
def one_hot_levels(spark, sf_dir):
    return regression.levels(features(spark, sf_dir), DESIGN.categorical)


@query
def one_hot_rows(spark, sf_dir):
    rows = clean(spark, sf_dir)
    baselines = {"fuel": "A", "drive": "fwd"}
    found = regression.listed_levels(rows, baselines)
    return regression.one_hot(rows.select("id", "fuel", "drive"), baselines, found)


@query
def one_hot_sparse(spark, sf_dir):
    return regression.sparse_features(clean(spark, sf_dir), "id", {"fuel": "A", "drive": "fwd", "model": "unknown", "type": "unknown"})


@query
def ols_many_levels(spark, sf_dir):
    """Price on mileage with a level for every part: coefficients stay a table."""
    design = regression.Design("log_price", ["odometer_10k"], {"l_partkey": "1"})
    rows = clean(spark, sf_dir).select("l_partkey", F.log("price").alias("log_price"), (F.col("odometer") / 10000).alias("odometer_10k"))
    return regression.fit_table(regression.product_sums(rows, design), design)


@query
def ols_by_segment(spark, sf_dir):
    return segment_models(features(spark, sf_dir))


@query
def ols_effects(spark, sf_dir):
    fitted = fitted_prices(spark, sf_dir)
    lines = regression.effects(fitted.model, regression.NUMERIC_LABELS, fixed.FEATURE_GROUP_NAMES)
    return spark.createDataFrame(lines, "effect_group string, label string, pct_effect double, coefficient double")


@query
def ols_importance(spark, sf_dir):
    fitted = fitted_prices(spark, sf_dir)
    names = {**{k: v[0] for k, v in regression.NUMERIC_LABELS.items()}, **fixed.FEATURE_GROUP_NAMES}
    lines = regression.group_importance(fitted.train, fitted.test, DESIGN, names)
    return spark.createDataFrame(lines, "feature_group string, r2_without double, r2_drop double")


@query
def ols_eval(spark, sf_dir):
    return listings_plan.model_score(fitted_prices(spark, sf_dir))


@query
def listing_totals(spark, sf_dir):
    return listings_plan.listing_totals(clean(spark, sf_dir), 2001)


@query
def listing_first_rows(spark, sf_dir):
    return listings_plan.first_rows(views.listings(spark, sf_dir), ["id", "posting_date", "price", "l_partkey"], 5)


@query
def error_by_band(spark, sf_dir):
    fitted = fitted_prices(spark, sf_dir)
    return regression.error_by_band(
        fitted.scored, "price", "predicted_price", 20000, 2, ("Asking price under 20000", "Asking price 20000 and above")
    )


@query
def prediction_sample(spark, sf_dir):
    fitted = fitted_prices(spark, sf_dir)
    return sampling.sample_n(fitted.scored.select("id", "price", "predicted_price"), 500, 7, "id")


@query
def sample_n(spark, sf_dir):
    vins = views.listings(spark, sf_dir).where("VIN is not null").select("VIN").distinct()
    return sampling.sample_n(vins, 200, 42, "VIN")


@query
def sample_batches(spark, sf_dir):
    vins = views.listings(spark, sf_dir).where("VIN is not null").select("VIN").distinct()
    return sampling.to_batches(sampling.sample_n(vins, 120, 42, "VIN"), "VIN", 50, "VIN")


# --- recalls ---


@query
def value_counts(spark, sf_dir):
    return reports.with_share(reports.value_counts(views.recalls(spark, sf_dir), "component"), "n", "pct")


@query
def top_k(spark, sf_dir):
    return reports.top_k(views.recalls(spark, sf_dir), "manufacturer", 10, ["NATION_3"])


@query
def sorted_head(spark, sf_dir):
    recalls = views.recalls(spark, sf_dir).select("recall_id", "manufacturer", "units")
    return recalls.orderBy(F.col("units").desc_nulls_last(), "recall_id").limit(15)


@query
def name_normalize(spark, sf_dir):
    recalls = views.recalls(spark, sf_dir).select("manufacturer")
    return (
        recalls.withColumn("mfr_norm", normalize_company(F.col("manufacturer")))
        .withColumn("short_name", short_name(F.col("manufacturer")))
        .groupBy("manufacturer", "mfr_norm", "short_name")
        .agg(F.count(F.lit(1)).alias("recalls"))
    )


@query
def group_mapping(spark, sf_dir):
    return recall_plan.group_mapping(recall_plan.with_names(views.recalls(spark, sf_dir), GROUPS))


@query
def display_names(spark, sf_dir):
    named = recall_plan.with_names(views.recalls(spark, sf_dir).drop("mfr_group"), GROUPS)
    return named.select("recall_id", "mfr_norm", "mfr_display")


@query
def year_matrix(spark, sf_dir):
    return trend.counts_on_axis(views.recalls(spark, sf_dir), "component", "year", 1993, 2002)


@query
def component_pivot(spark, sf_dir):
    values = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return trend.pivot_counts(views.recalls(spark, sf_dir), "year", "component", values)


def with_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    recalls = views.recalls(spark, sf_dir)
    return recalls.withColumn("mfr_norm", normalize_company(F.col("manufacturer")))


@query
def heat_matrix(spark, sf_dir):
    cells = trend.heat_cells(with_norm(spark, sf_dir), "mfr_norm", "component")
    return cells.withColumn("bucket", share_bucket(F.col("n"), F.col("largest")))


@query
def spikes(spark, sf_dir):
    return trend.spikes(trend.dense_counts(with_norm(spark, sf_dir), "mfr_norm", "month", 10), "mfr_norm", "month")


@query
def structural_breaks(spark, sf_dir):
    dense = trend.dense_counts(with_norm(spark, sf_dir), "mfr_norm", "month", 10)
    return trend.structural_breaks(
        dense, "mfr_norm", "month", (1990 * 12, BREAK_MONTH - 1), (BREAK_MONTH, 2010 * 12), 1.05, 0
    )


@query
def exposure_ranks(spark, sf_dir):
    table = trend.exposure(views.recalls(spark, sf_dir), "manufacturer", "units")
    return trend.first_by_rank(table, [F.col("recalls").desc(), F.col("manufacturer")], 50, "rank_by_recalls")


@query
def exposure_by_units(spark, sf_dir):
    top = trend.exposure(views.recalls(spark, sf_dir), "manufacturer", "units").orderBy(F.col("recalls").desc(), "manufacturer").limit(10)
    shown = top.select(short_name(F.col("manufacturer")).alias("label"), "recalls", "units_affected")
    return trend.first_by_rank(shown, [F.col("units_affected").desc(), F.col("label")], 10, "place")


@query
def tied_ranks(spark, sf_dir):
    counts = reports.value_counts(views.listings(spark, sf_dir), "VIN", "listings")
    return trend.average_rank(counts, "VIN", "listings", "rank_by_listings")


@query
def peak_period(spark, sf_dir):
    return trend.peak(views.recalls(spark, sf_dir), "month")


@query
def time_span(spark, sf_dir):
    spans = trend.time_span(views.telematics(spark, sf_dir), "ts", "tripID")
    return spans.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


@query
def totals(spark, sf_dir):
    return recall_plan.recall_totals(with_norm(spark, sf_dir))


@query
def severity_levels(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("doc_id", severity(F.col("text"), HIGH_TERMS, MEDIUM_TERMS).alias("severity"))


@query
def severity_validation(spark, sf_dir):
    docs = views.documents(spark, sf_dir).withColumn("severity", severity(F.col("text"), HIGH_TERMS, MEDIUM_TERMS))
    flags = {"src1": F.col("source") == "src1", "src2": F.col("source") == "src2"}
    return recall_plan.advisory_check(docs, flags, "text").withColumnRenamed("group", "flag")


@query
def announcing_sentences(spark, sf_dir):
    recalls = views.recalls(spark, sf_dir)
    return recalls.select("recall_id", announcing_sentence(F.col("description")).alias("sentence"))


@query
def year_extract(spark, sf_dir):
    sentence = announcing_sentence(F.col("description"))
    years = model_years(F.col("sentence"), (1980, 2000))
    found = views.recalls(spark, sf_dir).select("recall_id", sentence.alias("sentence")).select("recall_id", years.alias("_y"))
    return found.select("recall_id", F.size("_y").alias("n_years"), F.concat_ws(",", F.col("_y").cast("array<string>")).alias("years"))


@query
def classify_last_wins(spark, sf_dir):
    labelled = with_norm(spark, sf_dir).withColumn("label", classify_regex(F.col("mfr_norm"), GROUPS))
    return reports.share_by(labelled, ["label"], {"mean_units": F.col("units")}, "recalls")


# --- link between recalls and listings ---


def link_parts(spark: SparkSession, sf_dir: str):
    """Recalls, listing keys, vocabulary, (recall, year), and (recall, year, token) links."""
    recalls = views.recalls(spark, sf_dir)
    keys, vocabulary = recall_plan.listing_keys(views.listings(spark, sf_dir))
    vehicle = recalls.where(F.col("recall_type") == "Vehicle")
    parsed = linking.parsed_recalls(vehicle, "recall_id", "mfr_group", "description")
    years = linking.recall_years(parsed, "recall_id", "mfr_group")
    links = linking.link_table(parsed, vocabulary, "recall_id", "mfr_group")
    return recalls, keys, vocabulary, years, links


def key_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, keys, _, years, links = link_parts(spark, sf_dir)
    by_year, by_model = linking.recall_counts(years, links, "recall_id", "mfr_group")
    return linking.recall_features_by_key(keys, by_year, by_model, "mfr_group")


@query
def vocabulary(spark, sf_dir):
    return linking.valid_vocabulary(views.listings(spark, sf_dir), "model")


@query
def link_table(spark, sf_dir):
    return link_parts(spark, sf_dir)[4]


@query
def recall_features(spark, sf_dir):
    _, _, _, years, links = link_parts(spark, sf_dir)
    by_year, by_model = linking.recall_counts(years, links, "recall_id", "mfr_group")
    listings = views.listings(spark, sf_dir).select(
        "id", "l_partkey", "mfr_group", "year", first_token(F.col("model")).alias("model_token")
    )
    rows = linking.recall_features(listings, by_year, by_model, "mfr_group")
    return rows.select("id", "l_partkey", "mfr_group", "recalled_flag", "recall_count", "mfr_year_recall_count")


@query
def recall_key_contract(spark, sf_dir):
    _, _, _, years, links = link_parts(spark, sf_dir)
    _, by_model = linking.recall_counts(years, links, "recall_id", "mfr_group")
    repeated = joins.duplicate_keys(by_model, ["mfr_group", "year", "model_token"])
    return by_model.agg(F.count(F.lit(1)).alias("keys")).withColumn("repeated_keys", repeated.agg(F.count(F.lit(1))).scalar())


@query
def top_listed_models(spark, sf_dir):
    return linking.top_listed_models(key_features(spark, sf_dir), "manufacturer", "mfr_group")


@query
def recalled_by_year(spark, sf_dir):
    return linking.recalled_by_year(key_features(spark, sf_dir), "mfr_group")


@query
def coverage_listings(spark, sf_dir):
    return linking.listing_coverage(key_features(spark, sf_dir), "mfr_group")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    recalls, keys, _, years, links = link_parts(spark, sf_dir)
    return linking.join_quality(recalls, years, links, keys, "recall_id", "mfr_group", F.col("recall_type") == "Vehicle")


@query
def coverage_recalls(spark, sf_dir):
    counts = reports.value_counts(quality(spark, sf_dir), "join_quality", "recalls")
    return reports.with_share(counts, "recalls", "pct_of_recalls")


@query
def unmatched(spark, sf_dir):
    rows = quality(spark, sf_dir).where(F.col("join_quality").startswith("Unmatched"))
    return reports.top_k(rows, "manufacturer", 15, count="recalls")


@query
def low_before(spark, sf_dir):
    low = quality(spark, sf_dir).where(F.col("join_quality") == fixed.QUALITY_MAKER)
    return low.agg(
        F.count(F.lit(1)).alias("recalls"), (F.avg((F.col("year") < 1998).cast("int")) * 100).alias("pct_before")
    )


@query
def spot_check(spark, sf_dir):
    recalls, keys, _, years, links = link_parts(spark, sf_dir)
    by_year, by_model = linking.recall_counts(years, links, "recall_id", "mfr_group")
    found = linking.recall_features_by_key(keys, by_year, by_model, "mfr_group")
    return linking.spot_check(found, links, recalls, "recall_id", "mfr_group")


# --- texts ---


@query
def tfidf_top_terms(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    return recall_plan.vocabulary_bags(docs, "doc_id", "text", STOP_WORDS, 20, 2000)[1]


@query
def tfidf_weights(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    names, rows = recall_plan.topic_rows(docs, "doc_id", "text", STOP_WORDS, 20, 2000)
    numbers = spark.createDataFrame(list(enumerate(names)), "term_id long, term string")
    pairs = rows.select("doc_id", F.inline(F.arrays_zip("term_ids", "weights"))).toDF("doc_id", "term_id", "weight")
    return pairs.join(F.broadcast(numbers), "term_id").select("doc_id", "term", "weight")


def topic_parts(spark: SparkSession, sf_dir: str):
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    assigned, factors = recall_plan.topic_model(docs, "doc_id", "text", STOP_WORDS)
    return docs, assigned, factors


@query
def nmf_topics(spark, sf_dir):
    return topic_parts(spark, sf_dir)[1]


@query
def topic_summary(spark, sf_dir):
    docs, assigned, factors = topic_parts(spark, sf_dir)
    assigned = checkpointed(assigned)
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    examples = topics.topic_examples(assigned, docs, "doc_id", "text").select("topic", "place", "doc_id")
    return topics.top_terms(spark, factors).join(counts, "topic").join(examples, "topic")


@query
def topic_facts(spark, sf_dir):
    """What must hold of the topics whatever their numbers: nothing negative, an error below that of one direction for all texts."""
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    names, rows = recall_plan.topic_rows(docs, "doc_id", "text", STOP_WORDS)
    factors = topics.factorise(rows, names)
    assigned = topics.assign_topics(rows, factors, "doc_id")
    summed = rows.select(F.inline(F.arrays_zip("term_ids", "weights"))).groupBy("term_ids").agg(F.sum("weights").alias("s"))
    length = summed.agg(F.sum(F.col("s") * F.col("s"))).scalar()
    facts = assigned.agg(
        F.count(F.lit(1)).alias("with_terms"), F.count_if(F.col("topic_weight") < 0).alias("negative_weights"), F.max("topic").alias("last_topic")
    )
    bound = F.col("with_terms") - length / F.col("with_terms")
    return facts.select(
        docs.agg(F.count(F.lit(1))).scalar().alias("documents"), "with_terms", "negative_weights", F.lit(int((factors.topics < 0).sum())).alias("negative_cells"),
        (F.col("last_topic") < 8).alias("topics_in_range"), bound.alias("one_direction_error"), (F.lit(factors.errors[-1]) <= bound).alias("error_within"),
    )


@query
def topic_severity(spark, sf_dir):
    docs, assigned, _ = topic_parts(spark, sf_dir)
    levels = docs.select("doc_id", severity(F.col("text"), HIGH_TERMS, MEDIUM_TERMS).alias("severity"))
    return recall_plan.topic_severity(assigned.join(levels, "doc_id"))


def given_topics(spark: SparkSession, sf_dir: str):
    """Eight topics that SQL can build too: the kept terms in order, dealt one by one, each topic of another height."""
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    names, rows = recall_plan.topic_rows(docs, "doc_id", "text", STOP_WORDS)
    number = np.arange(len(names))
    cells = np.zeros((8, len(names)))
    cells[number % 8, number] = (1 + number % 3) * (1 + number % 8 / 16)
    factors = topics.Factors(names, cells)
    return docs, checkpointed(topics.assign_topics(rows, factors, "doc_id")), factors


@query
def topic_assignment(spark, sf_dir):
    docs, assigned, _ = given_topics(spark, sf_dir)
    return docs.select("doc_id").join(assigned, "doc_id", "left").fillna({"topic": -1})


@query
def topic_report(spark, sf_dir):
    docs, assigned, factors = given_topics(spark, sf_dir)
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    examples = topics.topic_examples(assigned, docs, "doc_id", "text").select("topic", "place", "doc_id")
    return topics.top_terms(spark, factors).join(counts, "topic").join(examples, "topic")


@query
def topic_levels(spark, sf_dir):
    docs, assigned, _ = given_topics(spark, sf_dir)
    levels = docs.select("doc_id", severity(F.col("text"), HIGH_TERMS, MEDIUM_TERMS).alias("severity"))
    return recall_plan.topic_severity(assigned.join(levels, "doc_id"))


# --- decoded specifications ---


def vin_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest listing of every VIN."""
    rows = views.listings(spark, sf_dir).where("VIN is not null").withColumn("manufacturer", F.lower("manufacturer"))
    return cleaning.latest_by(rows, "VIN", ["posting_date", "price", "odometer", "id"])


def spec_rows(latest: DataFrame) -> DataFrame:
    decoded = latest.where("l_orderkey % 31 <> 0")
    return decoded_status(decoded.select(*[F.expr(sql).alias(name) for name, sql in views.SPECS.items()]))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = vin_listings(spark, sf_dir)
    return spec_plan.compared(latest, spec_rows(latest), FUELS)


@query
def spec_flatten(spark, sf_dir):
    """The properties of each event as a decoder's reply: the event is the vehicle, ``k`` its engine."""
    item = F.concat(F.lit('[{"VIN":'), F.col("event_id"), F.lit(',"reply":'), F.col("props"), F.lit("}]"))
    replies = views.table(spark, sf_dir, "events").select(item.alias("value"))
    fields = {"VIN": "VIN", "reply.k": "API_Engine", "reply.make": "API_Make", "reply.year": "API_Year"}
    items = reply_items(replies, "value", "$", fields)
    decoded = spec_items(items, fields)
    return decoded.select(F.col("VIN").cast("long").alias("event_id"), F.col("API_Engine").alias("k"))


@query
def spec_totals(spark, sf_dir):
    return spec_plan.vin_totals(views.listings(spark, sf_dir), "^V[0-9]+-[0-7]$")


@query
def spec_sample(spark, sf_dir):
    return spec_plan.sample_totals(compared(spark, sf_dir))


@query
def spec_coverage(spark, sf_dir):
    return spec_plan.coverage(compared(spark, sf_dir))


@query
def spec_compare(spark, sf_dir):
    return comparing.comparison_report(compared(spark, sf_dir), comparing.FIELDS)


@query
def spec_conflicts_sample(spark, sf_dir):
    return comparing.conflict_samples(compared(spark, sf_dir), comparing.FIELDS, "VIN")


@query
def spec_rules(spark, sf_dir):
    return spec_plan.rule_report(compared(spark, sf_dir), 2001, fuels=["A", "N"], electric="R")


@query
def spec_taxonomy(spark, sf_dir):
    return spec_plan.taxonomy(compared(spark, sf_dir))


@query
def spec_decisions(spark, sf_dir):
    return spec_plan.decisions(comparing.decide(compared(spark, sf_dir)))


@query
def spec_enriched(spark, sf_dir):
    decided = comparing.decide(compared(spark, sf_dir)).where(F.col("action") != "Drop")
    return decided.select("VIN", "id", "year", "year_original", "drive_enriched", "API_Engine", "action")


@query
def drive_before_after(spark, sf_dir):
    return comparing.before_after(compared(spark, sf_dir), "drive_listing", "drive_enriched", "price")


# --- telematics ---


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.driving_signals(views.telematics(spark, sf_dir), SERIES, GAP, STEP)


@query
def time_deltas(spark, sf_dir):
    started = timeline.trip_starts(views.telematics(spark, sf_dir), SERIES, GAP)
    return timeline.own_rows(started).select("event_id", "deviceID", "time_delta")


@query
def sampling_report(spark, sf_dir):
    delta = F.col("time_delta")
    steps = [
        ("0 s", delta == 0), ("up to 60 s", (delta > 0) & (delta <= 60)), ("61 - 600 s", (delta > 60) & (delta <= 600)),
        ("601 - 1800 s", (delta > 600) & (delta <= 1800)), ("above 1800 s", delta > 1800),
    ]
    started = timeline.own_rows(timeline.trip_starts(views.telematics(spark, sf_dir), SERIES, GAP))
    return telematics_plan.sampling_report(started, steps)


@query
def sessions(spark, sf_dir):
    numbered = timeline.sessionize(views.telematics(spark, sf_dir), SERIES, GAP)
    return numbered.select("event_id", "deviceID", "trip", "position", "time_delta")


@query
def signal_ranges(spark, sf_dir):
    return reports.signal_ranges(views.telematics(spark, sf_dir), fixed.SIGNAL_LABELS)


@query
def quality_report(spark, sf_dir):
    return telematics_plan.quality_report(signals(spark, sf_dir), SERIES, 1800, MIN_RUN, 20, 150)


@query
def trips_with_gaps(spark, sf_dir):
    numbered = timeline.sessionize(views.telematics(spark, sf_dir), SERIES, GAP)
    return telematics_plan.trips_with_gaps(numbered, 1800)


@query
def frozen_runs(spark, sf_dir):
    runs = timeline.frozen_runs(signals(spark, sf_dir), SERIES, MIN_RUN)
    return runs.select("event_id", "repeats", F.col("frozen").cast("int").alias("frozen"))


@query
def rolling_features(spark, sf_dir):
    flags = [F.col(c).cast("int").alias(c) for c in ("harsh_brake", "harsh_accel", "idle")]
    return signals(spark, sf_dir).select("event_id", "accel_ms2", "speed_mean", "speed_std", "km", *flags)


@query
def trip_features(spark, sf_dir):
    trips = timeline.trip_features(signals(spark, sf_dir), SERIES)
    return trips.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query
def device_summary(spark, sf_dir):
    return timeline.device_summary(timeline.trip_features(signals(spark, sf_dir), SERIES), "deviceID", 100)


@query
def telematics_totals(spark, sf_dir):
    trips = checkpointed(timeline.trip_features(signals(spark, sf_dir), SERIES))
    devices = timeline.device_summary(trips, "deviceID", 100)
    return telematics_plan.telematics_totals(views.telematics(spark, sf_dir), trips, devices, "deviceID", "tripID")


@query
def example_trip(spark, sf_dir):
    numbered = timeline.sessionize(views.telematics(spark, sf_dir), SERIES, GAP)
    return timeline.example_trip(numbered, SERIES, 20, 5).select("event_id", "trip", "place", "minutes", "speed", "rpm")


# --- documents ---


@query
def result_document(spark, sf_dir):
    parts = {
        "audit": rule_audit(spark, sf_dir),
        "missingness": missingness(spark, sf_dir),
        "segments": price_by_segment(spark, sf_dir),
        "depreciation": depreciation(spark, sf_dir),
    }
    return document(parts)
