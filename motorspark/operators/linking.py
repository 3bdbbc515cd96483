"""Links between recall texts and listings: vocabulary, link table, features and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.functions import fixed_values as fixed
from motorspark.functions.text import announcing_sentence, first_token, model_years, name_tokens
from motorspark.functions.values import holds
from motorspark.operators.joins import count_distinct_by, enrich, in_key_set, match_ids
from motorspark.operators.reports import value_counts
from motorspark.session import checkpointed


def valid_vocabulary(
    df: DataFrame,
    model: str,
    min_count: int = 20,
    drop: Sequence[str] = tuple(fixed.AMBIGUOUS_TOKENS),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Model tokens (``model_token``) common and specific enough to be a join key."""
    counts = value_counts(df.select(first_token(F.col(model)).alias("model_token")), "model_token")
    return usable_tokens(counts, min_count, drop, stop_words)


def usable_tokens(
    counts: DataFrame,
    min_count: int = 20,
    drop: Sequence[str] = tuple(fixed.AMBIGUOUS_TOKENS),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Tokens of a (``model_token``, ``n``) table that are frequent, long enough, and no year or plain word."""
    token = F.col("model_token")
    return counts.where(
        (F.col("n") >= min_count)
        & (F.length(token) >= 2)
        & ~(token.rlike("^[0-9]+$") & (F.length(token) < 3))
        & ~token.rlike(r"^(19|20)[0-9]{2}$")
        & ~token.isin([*drop, *stop_words])
    ).select("model_token")


def with_model_token(df: DataFrame, token: str, vocabulary: DataFrame, spread: str | None = None) -> DataFrame:
    """Adds ``model_token``: the value of the token column where the vocabulary has it."""
    known = vocabulary.select(F.col("model_token").alias(token), "model_token")
    return enrich(df, known, [token], spread=spread)


def listing_keys(df: DataFrame, model: str, keep: Sequence[str]) -> DataFrame:
    """Distinct (kept columns, first model word) with their number of ``listings``.

    Everything the reports need is a sum over these, so a key held by a third of all listings is
    one row in every join that follows.
    """
    return df.groupBy(*keep, first_token(F.col(model)).alias("first_word")).agg(F.count(F.lit(1)).alias("listings"))


def parsed_recalls(recalls: DataFrame, id_column: str, group: str, description: str) -> DataFrame:
    """Model years and tokens of each announcing sentence; written out, as texts are read once.

    Recalls without a manufacturer group cannot meet a listing and are left out. The lines are dealt to parts of bounded size,
    as a file split may hold any number of recalls and the counts hold an entry for each (recall, year, token) of a part.
    """
    sentences = recalls.where(F.col(group).isNotNull()).select(
        id_column, group, announcing_sentence(F.col(description)).alias("_sentence")
    )
    parsed = sentences.select(
        id_column,
        group,
        model_years(F.col("_sentence")).alias("years"),
        F.array_distinct(name_tokens(F.col("_sentence"))).alias("tokens"),
    )
    return checkpointed(parsed.hint("rebalance", F.col(id_column)))


def recall_years(parsed: DataFrame, id_column: str, group: str) -> DataFrame:
    """One row per (recall, model year)."""
    return parsed.select(id_column, group, F.explode("years").alias("year"))


def link_table(parsed: DataFrame, vocabulary: DataFrame, id_column: str, group: str) -> DataFrame:
    """One row per (recall, model year, model token).

    Tokens meet the vocabulary before years are expanded, so the join sees each token once.
    """
    tokens = parsed.where(F.size("years") > 0).select(
        id_column, group, "years", F.explode("tokens").alias("model_token")
    )
    known = in_key_set(tokens, vocabulary, ["model_token"], id_column)
    return known.select(id_column, group, F.explode("years").alias("year"), "model_token")


def recall_counts(years: DataFrame, links: DataFrame, id_column: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Distinct recalls per (group, year) and per (group, year, token)."""
    by_year = count_distinct_by(years, [group, "year"], id_column, "mfr_year_recall_count")
    by_model = count_distinct_by(links, [group, "year", "model_token"], id_column, "recall_count")
    return by_year, by_model


def _count_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("recalled_flag", (F.col("recall_count") > 0).cast("int"))


def recall_features(
    listings: DataFrame, by_year: DataFrame, by_model: DataFrame, group: str, spread: str | None = None
) -> DataFrame:
    """Recall counts on every listing: one row in, one row out.

    Keys with many listings are left to adaptive execution, which splits them, unless ``spread`` names a column to salt by.
    ``model_token`` may be the plain first word of the model: the counts hold usable words only.
    """
    first = enrich(listings, by_model, [group, "year", "model_token"], {"recall_count": 0}, spread)
    both = enrich(first, by_year, [group, "year"], {"mfr_year_recall_count": 0}, spread)
    return _count_columns(both)


def recall_features_by_key(keys: DataFrame, by_year: DataFrame, by_model: DataFrame, group: str) -> DataFrame:
    """The same features on the lines of ``listing_keys``."""
    first = enrich(keys, by_model, [group, "year", "model_token"], {"recall_count": 0})
    return _count_columns(enrich(first, by_year, [group, "year"], {"mfr_year_recall_count": 0}))


def listing_coverage(features: DataFrame, group: str) -> DataFrame:
    """Listings per join level and their share of all listings."""
    mapped = F.col(group).isNotNull()
    levels = [
        ("Manufacturer mapped to a recall group", mapped),
        ("Model name usable as a join key", mapped & F.col("model_token").isNotNull()),
        ("Manufacturer + year has at least one recall", F.col("mfr_year_recall_count") > 0),
        ("Model + year has at least one recall (recalled_flag = 1)", F.col("recalled_flag") == 1),
    ]
    totals = features.agg(
        F.sum("listings").alias("_all"),
        *[F.coalesce(F.sum(F.when(holds(c), F.col("listings"))), F.lit(0)).alias(f"_n{i}") for i, (_, c) in enumerate(levels)],
    )
    lines = [
        F.struct(
            F.lit(name).alias("level"),
            F.col(f"_n{i}").alias("listings"),
            (F.col(f"_n{i}") * 100.0 / F.col("_all")).alias("pct_of_listings"),
        )
        for i, (name, _) in enumerate(levels)
    ]
    return totals.select(F.inline(F.array(*lines)))


def join_quality(
    recalls: DataFrame,
    years: DataFrame,
    links: DataFrame,
    listings: DataFrame,
    id_column: str,
    group: str,
    in_scope: Column,
) -> DataFrame:
    """Adds ``join_quality``, the best key that ties a recall to at least one listing."""
    by_model = match_ids(links, listings, [group, "year", "model_token"], id_column).withColumn("_model", F.lit(True))
    by_year = match_ids(years, listings, [group, "year"], id_column).withColumn("_year", F.lit(True))
    label = (
        F.when(~holds(in_scope), fixed.QUALITY_OUT_OF_SCOPE)
        .when(F.col("_model"), fixed.QUALITY_MODEL)
        .when(F.col("_year"), fixed.QUALITY_YEAR)
        .when(F.col(group).isNotNull(), fixed.QUALITY_MAKER)
        .otherwise(fixed.QUALITY_NONE)
    )
    return (
        recalls.join(by_model, id_column, "left")
        .join(by_year, id_column, "left")
        .withColumn("join_quality", label)
        .drop("_model", "_year")
    )


def top_listed_models(features: DataFrame, brand: str, group: str, k: int = 15) -> DataFrame:
    """The k most listed (brand, model word) pairs with share recalled and mean recalls."""
    label = F.concat_ws(" ", brand, "model_token").alias("model_label")
    n = F.sum("listings")
    return (
        features.where(F.col("model_token").isNotNull() & F.col(group).isNotNull())
        .groupBy(label)
        .agg(
            n.alias("listings"),
            (F.sum(F.col("recalled_flag") * F.col("listings")) * 100.0 / n).alias("share_recalled"),
            (F.sum(F.col("recall_count") * F.col("listings")) / n).alias("avg_recalls"),
        )
        .orderBy(F.col("listings").desc(), "model_label")
        .limit(k)
    )


def recalled_by_year(features: DataFrame, group: str) -> DataFrame:
    n = F.sum("listings")
    return (
        features.where(F.col(group).isNotNull())
        .groupBy("year")
        .agg(
            n.alias("listings"),
            (F.sum(F.col("recalled_flag") * F.col("listings")) * 100.0 / n).alias("share_recalled"),
        )
    )


def spot_check(features: DataFrame, links: DataFrame, recalls: DataFrame, id_column: str, group: str, k: int = 5) -> DataFrame:
    """The listing key with the most recalls, and the first k recalls linked to it."""
    keys = [group, "year", "model_token"]
    top = (
        features.where("recalled_flag = 1")
        .orderBy(F.col("recall_count").desc(), *keys)
        .limit(1)
        .select(*keys, "recall_count")
    )
    ids = links.join(F.broadcast(top), keys).select(id_column, *keys, "recall_count").distinct()
    return recalls.select(id_column, "subject").join(ids, id_column).orderBy(id_column).limit(k)
