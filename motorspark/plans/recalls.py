"""Recalls: names, trends, topics, severity, and the link to the listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.text import classify_regex, first_token, letters_only, normalize_company, severity
from motorspark.functions.values import map_values
from motorspark.operators import joins, linking, reports, topics, trend
from motorspark.session import checkpointed
from motorspark.sources.writers import write_document, write_summaries, write_table


def with_names(recalls: DataFrame, patterns: dict[str, str] = fixed.MANUFACTURER_GROUPS) -> DataFrame:
    """Adds the normalized name, the manufacturer group and the display name.

    The display name is the group or, without one, the most common raw spelling.
    """
    named = recalls.withColumn("mfr_norm", normalize_company(F.col("manufacturer"))).withColumn(
        "mfr_group", classify_regex(F.col("mfr_norm"), patterns)
    )
    spelling = reports.mode_by(named, "mfr_norm", "manufacturer", "_spelling")
    return (
        joins.enrich(named, spelling, ["mfr_norm"])
        .withColumn("mfr_display", F.coalesce("mfr_group", "_spelling"))
        .drop("_spelling")
    )


def group_mapping(named: DataFrame) -> DataFrame:
    return trend.counts_by(named, ["mfr_group", "manufacturer"], "recalls")


def topic_severity(scored: DataFrame) -> DataFrame:
    """Mean severity and share scored high per topic."""
    high = (F.col("severity") == 3).cast("int")
    return (
        scored.where("topic >= 0")
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("recalls"),
            F.avg("severity").alias("mean_severity"),
            (F.avg(high) * 100).alias("share_high"),
        )
    )


def vocabulary_bags(
    documents: DataFrame, id_column: str, text: str, stop_words: Sequence[str], min_df: int = 20, max_features: int = 2000
) -> tuple[DataFrame, DataFrame]:
    """The bags of the documents and the vocabulary; bags list no other terms, unless too many words are equally frequent."""
    blocks = checkpointed(topics.word_blocks(documents, id_column, text, stop_words))
    likely = topics.likely_terms(blocks, min_df, max_features)
    counted = checkpointed(topics.bags(documents, id_column, text, stop_words, among=likely, blocks=blocks))
    count = topics.document_count(documents, text)
    return counted, topics.frequent_terms(counted, count, min_df, max_features, **({} if likely is None else {"buckets": 0}))


def topic_rows(
    documents: DataFrame, id_column: str, text: str, stop_words: Sequence[str], min_df: int = 20, max_features: int = 2000
) -> tuple[list[str], DataFrame]:
    """The kept terms in order, at most ``max_features``, and the weighted rows of the documents."""
    counted, vocab = vocabulary_bags(documents, id_column, text, stop_words, min_df, max_features)
    found = vocab.select("term", "idf").orderBy("term").collect()
    names = [r["term"] for r in found]
    return names, checkpointed(topics.weighted_rows(counted, id_column, names, [r["idf"] for r in found]))


def topic_model(
    documents: DataFrame,
    id_column: str,
    text: str,
    stop_words: Sequence[str],
    k: int = 8,
    max_iter: int = 400,
    min_df: int = 20,
    max_features: int = 2000,
    seed: int = 42,
) -> tuple[DataFrame, topics.Factors]:
    """(id, topic, topic_weight) for every document, and the fitted topics."""
    names, rows = topic_rows(documents, id_column, text, stop_words, min_df, max_features)
    factors = topics.factorise(rows, names, k, max_iter, seed=seed)
    assigned = topics.assign_topics(rows, factors, id_column)
    everyone = documents.select(id_column).join(assigned, id_column, "left").fillna({"topic": -1})
    return everyone, factors


def topic_table(
    scored: DataFrame, factors: topics.Factors, documents: DataFrame, id_column: str, text: str, names: dict[int, str] | None = None
) -> DataFrame:
    """Topic, count, heaviest terms, example, mean severity and share scored high, and its name where one is given."""
    examples = topics.topic_examples(scored, documents, id_column, text, 1).select("topic", F.col(text).alias("example"))
    table = (
        topics.top_terms(documents.sparkSession, factors)
        .join(topic_severity(scored), "topic")
        .join(examples, "topic")
    )
    return table.withColumn("topic_name", map_values(F.col("topic").cast("int"), names)) if names else table


def advisory_check(scored: DataFrame, flags: dict[str, Column], text: str) -> DataFrame:
    has_text = letters_only(F.col(text)) != ""
    return reports.validate_flags(scored, flags, F.col("severity") == 3, "All recalls with text", has_text)


def listing_keys(listings: DataFrame, stop_words: Sequence[str] = (), min_count: int = 20, keep: Sequence[str] = ("manufacturer", "mfr_group", "year")) -> tuple[DataFrame, DataFrame]:
    """Distinct listing keys with their count and usable ``model_token``, and the vocabulary.

    Both come from one aggregation of the listings, which is written out for its several uses.
    """
    keys = checkpointed(linking.listing_keys(listings, "model", keep))
    words = keys.where("first_word is not null").groupBy(F.col("first_word").alias("model_token")).agg(
        F.sum("listings").alias("n")
    )
    vocabulary = checkpointed(linking.usable_tokens(words, min_count, stop_words=stop_words))
    return linking.with_model_token(keys, "first_word", vocabulary), vocabulary


#: Order of the published tables, "-" for descending; the others go by their first column.
ORDERS = {
    "recall_manufacturer_mapping": ["mfr_group", "-recalls", "manufacturer"],
    "recall_spikes": ["-z_score"],
    "recall_structural_breaks": ["-increase_ratio"],
    "recall_exposure": ["rank_by_recalls"],
    "recall_topics_severity": ["-mean_severity", "topic"],
    "recall_severity_validation": [],
    "join_coverage_listings": [],
    "join_coverage_recalls": ["-recalls", "join_quality"],
    "join_unmatched_examples": ["-recalls", "manufacturer"],
    "recalls_top_listed_models": ["-listings"],
    "component_counts": ["-recalls", "component"],
    "recall_totals": [],
}


def recall_totals(named: DataFrame) -> DataFrame:
    """One line: recalls, first year, last report date, raw and normalized names, units, and recalls without a component.

    A raw name has one normalized name, so sums by raw name and then by normalized name count both, and no row is multiplied.
    """
    by_name = named.groupBy("manufacturer", "mfr_norm").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("year"), F.max("report_date").alias("date"), F.sum("units").alias("units"),
        F.count_if(F.col("component").isNull()).alias("missing"),
    )
    by_norm = by_name.groupBy("mfr_norm").agg(
        F.count("manufacturer").alias("names"), F.sum("n").alias("n"), F.min("year").alias("year"), F.max("date").alias("date"),
        F.sum("units").alias("units"), F.sum("missing").alias("missing"),
    )
    return by_norm.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_recalls"),
        F.min("year").alias("first_year"),
        F.max("date").cast("string").alias("export_date"),
        F.coalesce(F.sum("names"), F.lit(0)).alias("raw_names"),
        F.count("mfr_norm").alias("manufacturers"),
        F.round(F.sum("units"), 2).alias("units_affected"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_component"),
        (F.sum("missing") * 100.0 / F.sum("n")).alias("missing_component_pct"),
    )


def low_quality_before(quality: DataFrame, year: int) -> DataFrame:
    """One line: recalls matched by their maker alone, and the share of them before a year."""
    low = quality.where(F.col("join_quality") == fixed.QUALITY_MAKER)
    return low.agg(F.count(F.lit(1)).alias("recalls"), (F.avg((F.col("year") < year).cast("int")) * 100).alias("pct_before"))


def run(
    recalls: DataFrame, clean_listings: DataFrame, out: str, last_full_year: int = 2025, min_recalls: int = 100,
    max_iter: int = 400, topic_names: dict[int, str] | None = None, low_quality_year: int = 1996,
) -> dict[str, DataFrame]:
    """Writes recalls_clean, usedcars_with_recalls and every recall summary; ``topic_names`` names topics by number."""
    spark = recalls.sparkSession
    stop_words = topics.default_stop_words()
    named = checkpointed(with_names(recalls))
    full_years = named.where(F.col("year") <= last_full_year)
    dense = trend.dense_counts(full_years, "mfr_display", "year", min_recalls)
    recent = (last_full_year - 9, last_full_year)
    previous = (last_full_year - 19, last_full_year - 10)

    documents = named.select("recall_id", F.col("consequence").alias("text"))
    assigned, factors = topic_model(documents, "recall_id", "text", stop_words, max_iter=max_iter)
    scored = checkpointed(
        named.withColumn("severity", severity(F.col("consequence"))).join(assigned, "recall_id", "left")
    )
    write_table(scored, out, "recalls_clean")

    listings = clean_listings.withColumn("mfr_group", map_values(F.col("manufacturer"), fixed.BRAND_GROUPS))
    keys, vocabulary = listing_keys(listings, stop_words)
    vehicle = named.where(F.col("recall_type") == "Vehicle")
    parsed = linking.parsed_recalls(vehicle, "recall_id", "mfr_group", "description")
    years = linking.recall_years(parsed, "recall_id", "mfr_group")
    links = linking.link_table(parsed, vocabulary, "recall_id", "mfr_group")
    by_year, by_model = (checkpointed(t) for t in linking.recall_counts(years, links, "recall_id", "mfr_group"))
    worded = listings.withColumn("model_token", first_token(F.col("model")))
    features = linking.recall_features(worded, by_year, by_model, "mfr_group")
    write_table(
        features.select("id", "mfr_group", "recalled_flag", "recall_count", "mfr_year_recall_count"), out, "usedcars_with_recalls"
    )
    by_key = linking.recall_features_by_key(keys, by_year, by_model, "mfr_group")
    quality = checkpointed(
        linking.join_quality(named, years, links, keys, "recall_id", "mfr_group", F.col("recall_type") == "Vehicle")
    )

    def share(df: DataFrame, column: str, count: str, pct: str) -> DataFrame:
        return reports.with_share(reports.value_counts(df, column, count), count, pct)

    unmatched = quality.where(F.col("join_quality") == fixed.QUALITY_NONE)
    order = [F.col("recalls").desc(), F.col("mfr_display")]
    flags = {
        "Park Outside Advisory": F.col("park_outside") == "Yes",
        "Do Not Drive Advisory": F.col("do_not_drive") == "Yes",
    }
    tables = {
        "recall_manufacturer_mapping": group_mapping(named),
        "recall_spikes": trend.spikes(dense, "mfr_display", "year"),
        "recall_structural_breaks": trend.structural_breaks(dense, "mfr_display", "year", previous, recent),
        "recall_exposure": trend.first_by_rank(trend.exposure(named, "mfr_display", "units"), order, 50, "rank_by_recalls"),
        "recall_topics_severity": topic_table(scored, factors, documents, "recall_id", "text", topic_names),
        "recall_severity_validation": advisory_check(scored, flags, "consequence"),
        "join_coverage_listings": linking.listing_coverage(by_key, "mfr_group"),
        "join_coverage_recalls": share(quality, "join_quality", "recalls", "pct_of_recalls"),
        "join_unmatched_examples": reports.top_k(unmatched, "manufacturer", 15, count="recalls"),
        "recalls_top_listed_models": linking.top_listed_models(by_key, "manufacturer", "mfr_group"),
        "recalled_by_year": linking.recalled_by_year(by_key, "mfr_group"),
        "recalls_per_year": reports.value_counts(full_years, "year", "recalls"),
        "component_counts": reports.top_k(named, "component", 10, count="recalls"),
        "recall_totals": recall_totals(named),
        "recall_peak_year": trend.peak(full_years, "year"),
        "recalls_by_maker_and_year": dense,
        "component_by_year": trend.counts_by(full_years.where("component is not null"), ["component", "year"], "recalls"),
        "recalls_low_quality_before": low_quality_before(quality, low_quality_year),
        "heat_cells": trend.heat_cells(full_years, "mfr_display", "component"),
    }
    write_summaries(tables, f"{out}/tables", ORDERS)
    write_document(f"{out}/documents", "recalls", tables, ORDERS)
    return tables
