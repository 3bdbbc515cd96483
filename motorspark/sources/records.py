"""Text records that may hold line breaks inside quotes, read by many tasks per file.

A file is read as physical lines, which Spark splits. Three facts per split are enough to know where every record starts: how
many lines have an odd number of quotes, and which of them are the first and the last. Their parity, summed up over the splits
before, says whether a split starts inside quotes. Then

* lines up to the first odd line of a split that starts inside belong to a record opened in an earlier split,
* lines from the last odd line of a split that ends inside open a record that goes on in a later one,
* all others form records that lie within their split and are put together where they are read.

The table of splits has one short row per split, as Spark's own list of them on the driver, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.session import checkpointed

SPLIT = ["_file", "_start"]
CHANGED = "the splits of the files changed between two reads of them; set spark.sql.files.minPartitionNum"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (value, split, order in the split, whether the number of quotes is odd); a return sign stays in the value."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"), (quotes % 2 == 1).alias("_odd"), "value",
    )


def split_states(lines: DataFrame) -> DataFrame:
    """One row per split: its first and last odd line, whether it starts and ends inside quotes, and where the record that is
    open at its start was opened; whether the lines of the file end in return signs, as its first one does; for the first split
    of a file also the place of that line.
    """
    odd_line = F.when(F.col("_odd"), F.col("_order"))
    splits = lines.groupBy(*SPLIT).agg(
        F.count_if("_odd").alias("odd"),
        F.min(odd_line).alias("first_odd"),
        F.max(odd_line).alias("last_odd"),
        F.min(F.when((F.col("_start") == 0) & ~F.col("value").isin("", "\r"), F.struct("_order", F.endswith("value", F.lit("\r")).alias("cr")))).alias("head"),
    )
    in_file = Window.partitionBy("_file")
    before = in_file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    splits = splits.withColumns({"header": F.col("head")["_order"], "returns": F.max(F.col("head")["cr"]).over(in_file)}).drop("head")
    states = splits.withColumn("inside", inside).withColumn("open", F.col("inside") != (F.col("odd") % 2 == 1))
    # a split opens a record unless all of it lies inside one
    opener = F.when(F.col("open") & (F.col("odd") > 0), F.col("_start"))
    return states.withColumn("opened_at", F.last(opener, ignorenulls=True).over(before))


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every record of the files as ``value``, line breaks inside quotes included; empty lines between records are left out.

    Files are UTF-8; a quote inside a value is doubled and such a value stands in quotes, so quotes are even in a record. With
    ``header`` the first line of every file that is not empty is left out. A quote that is never closed takes the rest of its file.
    Files are read three times: once for the table of splits, once for the few lines at split borders, once for the rest.
    """
    lines = physical_lines(spark, path)
    states = F.broadcast(checkpointed(split_states(lines)).withColumn("known", F.lit(True)))
    placed = lines.join(states, SPLIT, "left").where(F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.lit(CHANGED))))
    # a file whose lines end in return and line feed has line feeds only in its values, too
    line = F.when(F.col("returns") & F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    placed = placed.withColumn("value", line)
    if header:
        placed = placed.where(F.col("header").isNull() | (F.col("_order") > F.col("header")))
    goes_on = F.col("inside") & (F.col("first_odd").isNull() | (F.col("_order") <= F.col("first_odd")))
    opens = F.col("open") & (F.col("_order") >= F.col("last_odd"))
    across = F.coalesce(goes_on | opens, F.lit(False))
    inner = grouped_lines(placed.where(~across).select(F.concat("value", F.lit("\n")).alias("value"), *SPLIT, "_odd"))
    at_borders = across_splits(placed.where(across), F.when(goes_on, F.col("opened_at")).otherwise(F.col("_start")))
    found = inner.unionByName(at_borders).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    return found.where("value <> ''")


def across_splits(lines: DataFrame, opened_at: Column) -> DataFrame:
    """Records whose lines lie in several splits, put together by the split that opened them."""
    parts = lines.withColumn("_opened", opened_at).groupBy("_file", "_opened")
    ordered = F.array_sort(F.collect_list(F.struct("_start", "_order", "value")))
    return parts.agg(ordered.alias("parts")).select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def grouped_lines(lines: DataFrame) -> DataFrame:
    """Records of whole splits or of runs of lines that start outside quotes: lines are joined up to an even number of quotes.

    Lines come in their order and each ends in a line break, so a record is a run of the batch's own bytes: only the offsets
    change. A record that the end of a batch cuts waits for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            values = batch.column("value").cast(pa.large_string())
            if not len(values):
                continue
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            data = pa.py_buffer(values.buffers()[2])
            odd = np.asarray(batch.column("_odd").cast(pa.int8()), np.int64)
            even = (np.cumsum(odd) + bool(held)) % 2 == 0
            ends = np.flatnonzero(even) + 1
            if not len(ends):
                held.append(bytes(memoryview(data)[offsets[0] : offsets[-1]]))
                continue
            first = 0
            if held:
                first = int(ends[0])
                whole = b"".join([*held, bytes(memoryview(data)[offsets[0] : offsets[first]])])
                yield pa.record_batch([pa.array([whole.decode()], pa.string())], names=["value"])
                held, ends = [], ends[1:]
            if len(ends):
                bounds = np.concatenate([[first], ends])
                found = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets[bounds].tobytes()), data)
                yield pa.record_batch([found.cast(pa.string())], names=["value"])
                first = int(ends[-1])
            if first < len(values):
                held = [bytes(memoryview(data)[offsets[first] : offsets[-1]])]
        if held:
            yield pa.record_batch([pa.array([b"".join(held).decode()], pa.string())], names=["value"])

    return lines.select("value", "_odd").mapInArrow(run, "value string")
