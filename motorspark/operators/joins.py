"""Keyed enrichment, membership and the checks that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorspark.session import checkpointed


#: Lines of a key set that may be sent to every task.
BROADCAST = 20_000


class JoinContractError(ValueError):
    """A join's right side has a key twice, or the join changed the number of rows."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    found = duplicate_keys(df.dropna(subset=list(keys)), keys).limit(1).collect()
    if found:
        raise JoinContractError(f"key {list(keys)} is not unique: {found[0].asDict()}")


def assert_same_count(before: DataFrame, after: DataFrame) -> None:
    rows = before.count(), after.count()
    if rows[0] != rows[1]:
        raise JoinContractError(f"{rows[0]} rows before the join, {rows[1]} after")


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more rows than an average shuffle partition, and the parts of that size to cut them into.

    There are fewer such keys than shuffle partitions, whatever the data, so the table may be broadcast.
    """
    size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    part = counts.agg(F.sum("_n") / size).scalar()
    hot = counts.where(F.col("_n") > part).withColumn("_parts", F.ceil(F.col("_n") / part).cast("int"))
    return hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on], "_parts")


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: str, how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join of a left side with hot keys to a right side with one row per key.

    Rows of a hot key are cut into parts by the ``spread`` column of the left side, such as its id, and the right row of
    that key is offered once per part. Any other right row appears once.
    """
    keys = F.broadcast(hot_keys(left, on) if hot is None else hot)
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on]
    parts = F.coalesce("_parts", F.lit(1))
    drop = ["_parts", *[f"_hot_{c}" for c in on]]
    salted = left.join(keys, same, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop(*drop)
    return salted.join(offered(right, on, keys), ["_salt", *on], how).drop("_salt")


def offered(right: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """The right rows with a salt: 0, or for a hot key one row for each of its parts."""
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on]
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return right.join(hot, same, "left").withColumn("_salt", copies).drop("_parts", *[f"_hot_{c}" for c in on])


def enrich(
    left: DataFrame, right: DataFrame, on: Sequence[str], fill: dict | None = None, spread: str | None = None
) -> DataFrame:
    """Left join to a right side with one row per key; ``fill`` gives values for missing matches."""
    joined = left.join(right, list(on), "left") if spread is None else spread_join(left, right, on, spread)
    return joined.fillna(fill) if fill else joined


def in_key_set(fact: DataFrame, keys: DataFrame, on: Sequence[str], spread: str) -> DataFrame:
    """Fact rows whose key is in the key set, which is counted first.

    A few keys would pull all rows of a key into one task, since adaptive execution does not broadcast a side that fills few
    partitions: at most ``BROADCAST`` keys are sent to the rows. With more, rows of a hot key are cut by the ``spread`` column.
    """
    known = checkpointed(keys.select(*on).distinct())
    if known.count() <= BROADCAST:
        return fact.join(F.broadcast(known), list(on), "left_semi")
    return spread_join(fact, known, on, spread, "left_semi")


def match_ids(fact: DataFrame, keys: DataFrame, on: Sequence[str], id_column: str) -> DataFrame:
    """Ids of fact rows whose key is in the key set."""
    return in_key_set(fact.select(id_column, *on), keys, on, id_column).select(id_column).distinct()


def count_distinct_by(df: DataFrame, keys: Sequence[str], id_column: str, alias: str) -> DataFrame:
    """Distinct ids per key, so that a later join cannot fan out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct(id_column).alias(alias))
