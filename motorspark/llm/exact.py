"""Whole numbers of any size: from components, through Spark's sums, and back."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from decimal import Decimal
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 40
LIMBS = "cell long, limb int, value long"
#: Products of this size and their sums stay exact in doubles.
DOUBLE = 1 << 53


def integers(cells: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; Python's whole numbers where one is beyond 2^50."""
    with np.errstate(over="ignore"):
        scaled = np.floor(cells * scale)
    if not scaled.size or np.abs(scaled).max() <= 1 << 50:
        return scaled.astype(np.int64)
    out = np.empty(cells.shape, object)
    out.ravel()[:] = [floor(Fraction(x) * scale) for x in cells.ravel().tolist()]
    return out


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def limb_batch(totals: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    """Cells and their whole numbers as signed limbs, which Spark can add up as longs: 2^23 tasks do not overflow one."""
    rows: list[tuple[int, int, int]] = []
    for cell, total in totals:
        sign, rest, limb = (-1 if total < 0 else 1), abs(int(total)), 0
        while rest:
            rows.append((cell, limb, sign * (rest & ((1 << BITS) - 1))))
            rest >>= BITS
            limb += 1
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["cell", "limb", "value"])


def added(parts: DataFrame) -> dict[int, int]:
    """The sum of every cell over all tasks; as many rows as there are cells reach the driver."""
    out: dict[int, int] = defaultdict(int)
    for row in parts.groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():
        out[row.cell] += row.value << (BITS * row.limb)
    return out


def decimals(numbers: np.ndarray) -> pa.Array:
    """Whole numbers as decimal(38, 0); null beyond 38 digits."""
    if numbers.dtype != object:
        return pa.array(numbers).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(x)) if abs(int(x)) < 10**38 else None for x in numbers.tolist()], pa.decimal128(38, 0))
