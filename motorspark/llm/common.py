"""Helpers that the operators share: tables cut loose from their lineage, row keys, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the text operators: runs of ASCII letters and digits and of anything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python this package, as ``--py-files`` would, unless it is on their path already."""
    context = spark.sparkContext
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and context.applicationId not in _shipped:
        zipped = shutil.make_archive(os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), "motorspark"), "zip", ROOT, "motorspark")
        context.addPyFile(zipped)  # Spark's own file server hands it out
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of its own only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read from there: its lineage ends, its rows are fixed."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """A-Z only: ``lower`` would also change letters beyond ASCII."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits for (id, text), as hex; a null id differs from every id, a null text counts as empty."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))))


_held: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """One thing that a worker process keeps from task to task, such as a vocabulary and what it has learned."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives back what the process keeps: Spark reuses a worker for the next operator, which needs its memory."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)


def text_parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first, number, bytes, starts, ends."""
    release()
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        own = bounds[first : last + 1]
        yield first, last - first, data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0]
        first = last
