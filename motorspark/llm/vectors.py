"""Vectors as blocks: one row holds a few thousand ids and one matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "block long, ids binary, cells binary"


def finite(vector: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def width(vectors: DataFrame, vec_col: str) -> int:
    """The longest vector's length; shorter ones count as padded with zeros."""
    return int(vectors.agg(F.max(F.size(vec_col))).first()[0] or 0)


def matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """The rows of a list column, padded with zeros to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=kind)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(vectors: DataFrame, dims: int, rows: int, kind: type = np.float64) -> DataFrame:
    """Each partition's (id, vec) rows in their order as blocks of ``rows`` rows; a block's number is made of partition and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, cells, held = [], [], 0

        def block(ids, cells, number):
            return pa.record_batch([pa.array([number]), pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], names=["block", "ids", "cells"])

        for batch in batches:
            ids.append(np.asarray(batch.column("id"), dtype=np.int64))
            cells.append(matrix(batch.column("vec"), dims, kind))
            held += len(ids[-1])
            if held >= rows:
                all_ids, all_cells = np.concatenate(ids), np.concatenate(cells)
                for at in range(0, held - held % rows, rows):
                    yield block(all_ids[at : at + rows], all_cells[at : at + rows], number)
                    number += 1
                ids, cells, held = [all_ids[held - held % rows :]], [all_cells[held - held % rows :]], held % rows
        if held:
            yield block(np.concatenate(ids), np.concatenate(cells), number)

    return vectors.select("id", "vec").mapInArrow(pack, BLOCK)


def unpack(ids: bytes, cells: bytes, dims: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, dtype=np.int64)
    return numbers, np.frombuffer(cells, dtype=kind).reshape(len(numbers), dims)


def joined(blocks: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of one partition as one, in their order."""
    parts = [unpack(r.ids, r.cells, dims) for r in blocks.sort_values("block").itertuples()]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def part(block: str = "block") -> Column:
    """The number of the partition that a block was made in."""
    return F.shiftright(block, 32).cast("int")


def each(count: int) -> Column:
    """Exploded: the numbers below ``count``."""
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
