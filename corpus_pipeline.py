"""The corpus pipeline: each stage works on all that the stage before it kept.

Quality classifier, near duplicates, repeated passages, packing. The first three return the columns of ``documents``; the
last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm.common import row_key, ship, written
from motorspark.llm.near_duplicates import near_duplicates
from motorspark.llm.packing import packed_documents
from motorspark.llm.quality import held_out, scored, train
from motorspark.llm.repeats import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more, empty ones included if they score so."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, ~held_out(F.col("id")), "doc_id", "text", "quality")
    return scored(docs, model, keep=tuple(docs.columns)).filter("score >= 0.7").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    ship(spark)
    kept = near_duplicates(docs, threshold=0.8).filter("first").select("rk")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(row_key("doc_id", "text")).alias("rk"))
    # a repeated row has one digest: it is kept once
    return rows.join(kept, "rk").dropDuplicates(["rk"]).select("row.*")


def fresh_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes under repeated strings of 200 bytes; halves of a character go with them, nulls stay."""
    ship(spark)
    found = without_repeats(docs, keep=tuple(docs.columns), as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 1024 ids."""
    ship(spark)
    found = packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, size=1024, specials=True)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", F.col("n").cast("long").alias("length"), "ids", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each_group),
    ("repeated passages", fresh_text),
    ("best-fit packing", packed),
]

#: No stage can be stated in SQL; the tests hold each one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
