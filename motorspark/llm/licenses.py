"""License scan by diagonal voting.

Texts and templates are words; every two neighbouring words are hashed. Spark joins all these hashes of all texts to the
places where templates have them. A hit votes for its diagonal, the text's place less the template's; hits of one place of
the text lie on one diagonal. Neighbouring diagonals (words put in or left out) are merged, and what their votes cover of
the template decides: a phrase needs all of it on one diagonal, a notice a share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.llm.common import text_parts, written
from motorspark.llm.near_duplicates import STEP, mixed, word_hashes

#: Phrases that must stand as they are, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Sentences of public licenses and notices, and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
]
#: Diagonals at most this far apart are one match with words put in or left out.
DRIFT = 3
#: What a notice needs covered of its pairs of words.
SHARE = 0.75
#: Pairs of words of all templates together up to which the join sends them to every task.
BROADCAST_PAIRS = 100_000
#: Every text has one more pair, which matches this template: so texts without a hit come through the join as well.
TEXT = "#text"
TEXT_PAIR = -1


def pair_hashes(owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every two neighbouring words of one text."""
    first = np.flatnonzero(owner[1:] == owner[:-1])
    return owner[first], mixed(mixed(words[first] + STEP) + words[first + 1]).view(np.int64)


def template_pairs(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(hash, template, at) of every pair of words of the templates, which are told apart by their text."""
    rows = [(TEXT_PAIR, TEXT, 0)]
    for text, _ in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        _, hashes = pair_hashes(*word_hashes(data, np.array([0]), np.array([len(data)])))
        rows += [(int(h), text, at) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "hash long, template string, at int")


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, data, starts, ends in text_parts(batch.column("text")):
            owner, words = word_hashes(data, starts, ends)
            text, hashes = pair_hashes(owner, words)
            cuts = np.searchsorted(text, np.arange(n + 1))
            pairs = np.insert(hashes, cuts[1:], TEXT_PAIR)
            offsets = pa.array((cuts + np.arange(n + 1)).astype(np.int32))
            counts = pa.array(np.bincount(owner, minlength=n).astype(np.int64))
            yield pa.record_batch(
                [batch.column("row").slice(first, n), batch.column("id").slice(first, n), counts, pa.ListArray.from_arrays(offsets, pa.array(pairs))],
                names=["row", "id", "n_words", "pairs"],
            )


def license_scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, places, labels_of_phrases, labels, score, spans).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case; a null text is empty.
    ``places`` are the ascending first words of all phrases, ``spans`` the verified matches (label, first, last word),
    ``labels`` their labels and those of the phrases, sorted. ``score`` is the largest share of a template that a match
    covers, 1 where a phrase stands, 0 without any hit. Null ids and repeated rows each get a row of their own; other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    templates = list(dict.fromkeys([*phrases, *notices]))
    short = [t for t, _ in templates if len(t.split()) < 2]
    if short:
        raise ValueError(f"templates need two words: {short}")
    pairs = template_pairs(spark, [(t, "") for t in dict.fromkeys(t for t, _ in templates)])
    if sum(len(t.split()) for t, _ in templates) <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_kind = texts.schema["id"].dataType.simpleString()
    paired = texts.mapInArrow(pairs_of, f"row long, id {id_kind}, n_words long, pairs array<long>")
    hits = paired.select("row", "id", "n_words", F.posexplode("pairs").alias("place", "hash")).join(pairs, "hash")
    hits = written(hits.select("row", "id", "n_words", "template", "at", "place"), "hits")

    facts = spark.createDataFrame([(t, label, kind, len(t.split()) - 1) for kind, group in (("phrase", phrases), ("notice", notices)) for t, label in group], "template string, label string, kind string, size int")
    votes = (
        hits.filter(F.col("template") != TEXT)
        .groupBy("row", "template", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
        .join(F.broadcast(facts), "template")
    )
    standing = votes.filter((F.col("kind") == "phrase") & (F.col("votes") == F.col("size")))
    standing = standing.select("row", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("last"), F.lit(1.0).alias("score"), "kind")
    by_diagonal = Window.partitionBy("row", "template", "label").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    matches = (
        votes.filter("kind = 'notice'")
        .withColumn("match", F.sum(F.when(step <= DRIFT, 0).otherwise(1)).over(by_diagonal))
        .groupBy("row", "template", "label", "kind", "size", "match")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.min("low").alias("first"), (F.max("high") + 1).alias("last"))
        .select("row", "label", "first", "last", F.least(F.lit(1.0), F.col("covered") / F.col("size")).alias("score"), "kind")
    )
    found = (
        standing.unionByName(matches).withColumn("sure", (F.col("kind") == "phrase") | (F.col("score") >= SHARE))
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "phrase", F.col("first")))).alias("places"),
            F.sort_array(F.collect_set(F.when(F.col("kind") == "phrase", F.col("label")))).alias("of_phrases"),
            F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("label")))).alias("labels"),
            F.max("score").alias("score"),
            F.sort_array(F.collect_list(F.when(F.col("sure"), F.struct("label", "first", "last")))).alias("spans"),
        )
    )
    rows = hits.filter(F.col("template") == TEXT).select("row", "id", "n_words").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("of_phrases", none).alias("labels_of_phrases"),
        F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<label:string,first:int,last:int>>")).alias("spans"),
    )
