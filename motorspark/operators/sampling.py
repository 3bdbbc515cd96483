"""Seeded samples and splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.operators.ordering import running_sums


def key_digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows with the smallest key digest: a top-n, not a full sort."""
    return df.orderBy(key_digest(key, seed), F.col(key)).limit(n)


def in_train(key: str, seed: int, share: float = 0.8) -> Column:
    """True for about ``share`` of all keys, the same ones in every run."""
    bound = f"{round(share * 0x10000):04x}"
    return F.substring(key_digest(key, seed), 1, 4) < F.lit(bound)


def to_batches(sample: DataFrame, key: str, size: int, order: str) -> DataFrame:
    """Request batches of at most ``size`` keys, numbered from 0 in the given order.

    Places are counted in ranges of the order (keys that are equal in it by the key), so a sample of any size is numbered in parallel.
    """
    placed = running_sums(sample.select(*dict.fromkeys([key, order])), [], list(dict.fromkeys([order, key])), F.lit(1))
    return (
        placed.select(key, F.col("before").alias("_place"))
        .withColumn("batch", F.floor(F.col("_place") / size))
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("_place", key))).alias("_items"))
        .select("batch", F.size("_items").alias("size"), F.concat_ws(";", F.transform("_items", lambda i: i[key])).alias("keys"))
    )
