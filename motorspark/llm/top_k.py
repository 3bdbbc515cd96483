"""Exact top-k search by inner product over norm-sorted blocks.

Vectors of integers are dealt by descending length into blocks. A group of the search is one block of queries against a
run of candidate blocks, longest first. Within a group a candidate goes through three gates: |q| |c| against the k-th
score so far, which ends the run for a query; the inner product of the first rotated coordinates plus the Cauchy-Schwarz
bound |rest of q| |rest of c|; and the inner product itself, in whole numbers. The rotation comes from the singular
vectors of a bounded sample; any rotation gives the same results, a good one prunes more. Groups return k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.llm.common import written
from motorspark.llm.vectors import each, finite, joined, matrix, packed, part, unpack, width

SAMPLE = 4096
#: Bytes that hold any sum of products of doubles.
WIDE = 264
FOUND = "q int, at long, query_id long, vec_id long, side int, score long, wide binary"


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec, norm2) of the rows that take part; vec holds floor(scale * x), as doubles without a fraction."""

    def value(x: Column) -> Column:
        product = x.cast("double") * scale
        # from 2^53 on a double has no fraction, and floor would end at the largest long
        return F.when(F.abs(product) < 2.0**53, F.floor(product).cast("double")).otherwise(product)

    rows = vectors.filter(finite(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, value).alias("vec")).filter(finite(F.col("vec")))
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))


def rotation(vectors: DataFrame, dims: int, rows: int = SAMPLE) -> np.ndarray:
    """Right singular vectors, as columns, of the ``rows`` vectors with the smallest hash of the id."""
    import pyarrow as pa

    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow().column("vec")
    cells = matrix(sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample, dims)
    if not cells.any():
        return np.eye(dims)
    return np.linalg.svd(cells / np.abs(cells).max(), full_matrices=True)[2].T


def products(q: np.ndarray, q_len: float, c: np.ndarray, c_len: np.ndarray) -> np.ndarray:
    """Exact inner products of one vector with rows: doubles hold them below 2^53, longs below 2^63, else Python's numbers."""
    bound = q_len * c_len
    if (bound < 2**52).all():
        return (c @ q).astype(np.int64)
    fits = bound < 2**62
    out = np.zeros(len(c), dtype=object)
    out[fits] = c[fits].astype(np.int64) @ q.astype(np.int64)
    numbers = [int(x) for x in q.tolist()]
    for i in np.flatnonzero(~fits):
        out[i] = sum(x * int(y) for x, y in zip(numbers, c[i].tolist(), strict=True))
    return out


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def sortable(scores: list[np.ndarray]) -> dict[str, list]:
    """(side, score, wide): in falling order of the three the scores fall; ``score`` is null beyond a long, ``wide`` elsewhere."""
    numbers = [int(x) for s in scores for x in s.tolist()]
    side = [(x >= 2**63) - (x < -(2**63)) for x in numbers]
    return {
        "side": side, "score": [None if s else x for s, x in zip(side, numbers, strict=True)],
        "wide": [(x + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big") if s else None for s, x in zip(side, numbers, strict=True)],
    }


def near_double(number: int) -> float:
    """The number as a double, for bounds that leave slack; the largest double stands for what is larger."""
    most = int(np.finfo(float).max)
    return float(max(-most, min(most, int(number))))


def search(queries: tuple, runs: list[tuple], basis: np.ndarray, k: int, head: int) -> pd.DataFrame:
    """The k best of the candidate blocks, longest vectors first, for each query of a block."""
    q_ids, q = queries
    q_rot, n = q @ basis, len(q_ids)
    q_len = np.sqrt((q_rot**2).sum(1))
    q_rest = np.sqrt((q_rot[:, head:] ** 2).sum(1))
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
    least, floor = np.full(n, -np.inf), [None] * n  # the k-th score so far: about, for bounds, and exactly
    for ids, c in runs:
        c_rot = c @ basis
        c_len = np.sqrt((c_rot**2).sum(1))
        c_rest = np.sqrt((c_rot[:, head:] ** 2).sum(1))
        top_len = c_len.max() if len(c_len) else 0
        slack = 1e-6 * (1 + q_len * top_len)
        # asked the other way round, so that a bound beyond a double rules nothing out
        live = np.flatnonzero(~(q_len * top_len + slack < least))
        if not len(live):
            continue
        bound = q_rot[live, :head] @ c_rot[:, :head].T + np.outer(q_rest[live], c_rest)
        passed = ~(bound + slack[live, None] < least[live, None])
        # sums below 2^53 are exact in double precision
        plain = q_len.max() * top_len < 2**52 and passed.mean() >= 0.2
        scores = (q[live] @ c.T).astype(np.int64) if plain else None
        for row, at in enumerate(live):
            keep = np.flatnonzero(passed[row])
            got = scores[row, keep] if plain else products(q[at], q_len[at], c[keep], c_len[keep])
            over = ids[keep] != q_ids[at]
            if floor[at] is not None:
                over &= (got >= floor[at]).astype(bool)
            if not over.any():
                continue
            s = np.concatenate([best[at][0], got[over]])
            v = np.concatenate([best[at][1], ids[keep][over]])
            top = largest(s, v, k)
            best[at] = s[top], v[top]
            if len(top) == k:
                floor[at] = int(s[top[-1]])
                least[at] = near_double(floor[at])
    counts = [len(b[0]) for b in best]
    return pd.DataFrame({
        "at": np.repeat(np.arange(n), counts), "query_id": np.repeat(q_ids, counts),
        "vec_id": np.concatenate([b[1] for b in best]) if n else [], **sortable([b[0] for b in best]),
    }).astype({"score": "Int64"})


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0,
    query_rows: int = 512, block_rows: int = 4096, run_rows: int = 16384, head: int = 24,
) -> DataFrame:
    """The k largest inner products of floor(scale * x) for every query: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on the column ``id``. Queries meet every row but those with their own id; ties go to the
    smaller vec_id, and all candidates are returned where there are fewer than k. Rows without id, or whose vector is null
    or holds a null or non-finite component (also one that scaling makes so), take no part. Shorter vectors count as padded
    with zeros. Ranks are exact at any size; a score beyond a long is null. A repeated row is a candidate as often as it occurs, and a repeated query is answered each time.
    Other columns are not read. An empty table gives no rows.
    """
    rows = whole(vectors, id_col, vec_col, scale)
    dims = width(rows, "vec")
    basis = rotation(rows, dims)
    runs = max(1, -(-rows.count() // run_rows))
    order = [F.desc("norm2"), F.col("id"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(runs, *order).sortWithinPartitions(F.desc("norm2"), "id")
    blocks = written(packed(ordered, dims, block_rows), "top-k-blocks")
    asked = rows.filter(is_query)
    groups = max(1, -(-asked.count() // query_rows))
    asked = asked.repartitionByRange(groups, "id", F.monotonically_increasing_id())
    queries = written(packed(asked, dims, query_rows), "top-k-queries")
    # a stated query set against all rows, in blocks: each block of either side is sent to the groups it is part of
    q_side = queries.select(part().alias("q"), each(runs).alias("run"), "block", "ids", "cells")
    c_side = blocks.select(each(groups).alias("q"), part().alias("run"), "block", "ids", "cells")

    def group(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        candidates = [unpack(r.ids, r.cells, dims) for r in cs.sort_values("block").itertuples()]
        with np.errstate(over="ignore", invalid="ignore"):
            return search(joined(qs, dims), candidates, basis, k, min(head, dims)).assign(q=qs["q"][0])

    found = q_side.groupBy("q", "run").cogroup(c_side.groupBy("q", "run")).applyInPandas(group, FOUND)
    rank = F.row_number().over(Window.partitionBy("q", "at").orderBy(F.desc("side"), F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
