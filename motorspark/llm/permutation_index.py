"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. A shard of the index holds some thousand vectors and one
inverted file per pivot: the vectors that have the pivot among their nearest, with its place in their order. A query
walks the files of its own nearest pivots and adds up the footrule distance of the two orders (a pivot missing from an
order counts as standing behind its end); the best of each shard are ranked anew by the exact cosine, and the best of all
shards are the answer. Pivots come from a bounded sample and lie far from each other, so that a cluster of many rows gets
few of them; every vector is indexed, and its order is written once with its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.llm.common import written
from motorspark.llm.vectors import BLOCK, each, finite, joined, matrix, packed, part, width

SAMPLE = 4096
EMPTY = {"q": [], "at": [], "query_id": [], "vec_id": [], "score": []}


def choose_pivots(rows: DataFrame, dims: int, count: int, sample: int = SAMPLE) -> np.ndarray:
    """``count`` vectors of length one, each the farthest from those before it, of the ``sample`` ones with the smallest hashes.

    The sample is of different vectors and has the same bound at every size. Vectors of one direction give one pivot.
    """
    taken = rows.groupBy("vec").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample)
    cells = unit(matrix(taken.select("vec").toArrow().column("vec"), dims))
    chosen, nearest_one, at = [], np.full(len(cells), -np.inf), 0
    while len(chosen) < min(count, len(cells)) and nearest_one[at] < 1 - 1e-9:
        chosen.append(at)
        nearest_one = np.maximum(nearest_one, cells @ cells[at])
        at = int(np.argmin(nearest_one))
    return cells[chosen]


def unit(cells: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    top = np.abs(cells).max(axis=1, keepdims=True) if cells.size else np.ones((len(cells), 1))
    scaled = cells / top
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def scaled(cells: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which changes no cosine, so that squares neither vanish nor overflow."""
    return np.ldexp(cells, -np.frexp(np.abs(cells).max(axis=1, keepdims=True))[1]) if cells.size else cells


def orders(cells: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row of unit length, nearest first."""
    return np.argsort(-(cells @ pivots.T), axis=1, kind="stable")[:, :length]


def inverted_files(order: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot: the rows that list it, and its place in their order."""
    rows = np.repeat(np.arange(len(order)), order.shape[1])
    places = np.tile(np.arange(order.shape[1], dtype=np.int32), len(order))
    by_pivot = np.argsort(order.ravel(), kind="stable")
    cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
    return [(rows[by_pivot[a:b]], places[by_pivot[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def footrule(order: np.ndarray, files: list, rows: int, length: int) -> np.ndarray:
    """Footrule distance, up to a constant that all rows share, of one query's order to every row of the shard.

    A listed pair counts |place - place'| against the (length - place) + (length - place') that two missing ones count.
    """
    total = np.zeros(rows, dtype=np.int32)
    for place, pivot in enumerate(order):
        who, there = files[pivot]
        total[who] += np.abs(there - place) - (length - there) - (length - place)
    return total


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 256,
    length: int = 96, shard_rows: int = 8192, query_rows: int = 128, share: float = 0.1, least: int = 400,
) -> DataFrame:
    """The k nearest found by cosine for every query: (query_id, rank, vec_id, score).

    In each shard the max(``least``, ``share`` of the shard) rows with the smallest footrule distance get the exact cosine.
    ``is_query`` is a condition on the column ``id``. Queries meet every row but those with their own id; ties go to the
    smaller vec_id. At most 65,536 pivots. Rows without id, and null or zero vectors or such with null or non-finite components, take no part.
    Shorter vectors count as padded with zeros. Repeated rows are candidates as often as they occur, and a repeated query
    is answered each time. Other columns are not read. An empty table gives no rows.
    """
    rows = vectors.filter(finite(F.col(vec_col)) & F.col(id_col).isNotNull() & F.exists(vec_col, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    dims = width(rows, "vec")
    places = choose_pivots(rows, dims, pivots)
    length = min(length, max(1, len(places)))
    count, dealt = max(1, -(-rows.count() // shard_rows)), F.monotonically_increasing_id()
    spread = rows.repartitionByRange(count, F.xxhash64("id"), dealt).sortWithinPartitions("id")

    def with_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c, np.float64).reshape(-1, dims) for c in batch.column("cells").to_pylist()]
            order = [orders(unit(c), places, length).astype(np.uint16).tobytes() for c in cells]
            yield pa.record_batch([*batch.columns, pa.array(order, pa.binary())], names=[*batch.schema.names, "orders"])

    shards = written(packed(spread, dims, shard_rows).mapInArrow(with_order, f"{BLOCK}, orders binary"), "index-shards")
    asked = rows.filter(is_query)
    groups = max(1, -(-asked.count() // query_rows))
    queries = written(packed(asked.repartitionByRange(groups, "id", dealt), dims, query_rows), "index-queries")
    # a stated query set against all rows, in blocks: each block of either side is sent to the groups it is part of
    q_side = queries.select(part().alias("q"), each(count).alias("shard"), "block", "ids", "cells")
    c_side = shards.select(each(groups).alias("q"), part().alias("shard"), "block", "ids", "cells", "orders")

    def group(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame(EMPTY)
        (q_ids, q), (ids, cells) = joined(qs, dims), joined(cs, dims)
        q, cells, asked_orders = scaled(q), scaled(cells), orders(unit(q), places, length)
        q_len, c_len = np.sqrt((q**2).sum(1)), np.sqrt((cells**2).sum(1))
        found = np.frombuffer(b"".join(cs.sort_values("block")["orders"]), np.uint16).reshape(len(ids), length)
        files = inverted_files(found, len(places))
        out = []
        for at, order in enumerate(asked_orders):
            far = footrule(order, files, len(ids), length)
            far[ids == q_ids[at]] = np.iinfo(np.int32).max
            wanted = min(len(ids), max(least, int(share * len(ids))))
            # a shard's rows are in the order of their ids, so a stable sort gives ties to the smaller id
            limit = np.partition(far, wanted - 1)[wanted - 1]
            near = np.flatnonzero(far <= limit)
            near = near[np.argsort(far[near], kind="stable")][:wanted]
            near = near[ids[near] != q_ids[at]]
            score = (cells[near] * q[at]).sum(1) / (c_len[near] * q_len[at])
            top = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"at": at, "query_id": q_ids[at], "vec_id": ids[near][top], "score": score[top]}))
        return pd.concat(out).assign(q=qs["q"][0])

    found = q_side.groupBy("q", "shard").cogroup(c_side.groupBy("q", "shard")).applyInPandas(group, "q int, at long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
