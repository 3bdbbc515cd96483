"""Vector codes from one codebook per part, found by equal-average search.

Vectors of whole numbers are cut into equal parts. A codebook's entries are sorted by the sum of their components. The search
starts where a part's own sum would stand and expands outward, the nearer sum first: the squared distance is at least the
squared gap of the sums over the part's length, so it ends once that strictly exceeds the best distance, and entries of
equal distance are all seen. Each round is one Spark job that assigns all parts and adds up the members of every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.llm.common import partitions, written
from motorspark.llm.exact import LIMBS, added, decimals, integers, largest, limb_batch
from motorspark.llm.vectors import finite, matrix, width

Books = list[list[list[int]]]


@dataclass(frozen=True)
class Codes:
    """``rows``: the kept columns as ``row``, the code of every part, the squared distance; ``books``: entries per part."""

    rows: DataFrame
    books: Books

    @property
    def digest(self) -> str:
        """sha256 of all components by part, entry and place, as decimal numbers between commas."""
        numbers = [str(c) for book in self.books for entry in book for c in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower one of equals, and the squared distance."""
    size = book.shape[1]
    order = np.argsort(book.sum(1), kind="stable")
    sums, own = book.sum(1)[order], x.sum(1)
    right = np.searchsorted(sums, own, side="left")
    left = right - 1
    best, code = np.zeros(len(x), x.dtype), np.full(len(x), -1)
    open_rows = np.arange(len(x))
    while len(open_rows):
        lower, upper = left[open_rows], right[open_rows]
        below = own[open_rows] - sums[np.maximum(lower, 0)]
        over = sums[np.minimum(upper, len(sums) - 1)] - own[open_rows]
        to_left = (lower >= 0) & ((upper >= len(sums)) | (below <= over).astype(bool))
        gap = np.where(to_left, below, over)
        known = best[open_rows]
        inside = (code[open_rows] < 0) | (gap * gap <= size * known).astype(bool)
        go_on = inside & (to_left | (upper < len(sums)))
        open_rows, to_left = open_rows[go_on], to_left[go_on]
        place = np.where(to_left, left[open_rows], right[open_rows])
        entry = order[place]
        rest = x[open_rows] - book[entry]
        distance = (rest * rest).sum(1)
        known, named = best[open_rows], code[open_rows]
        better = (named < 0) | (distance < known).astype(bool) | ((distance == known).astype(bool) & (entry < named))
        best[open_rows[better]], code[open_rows[better]] = distance[better], entry[better]
        left[open_rows] -= to_left
        right[open_rows] += ~to_left
    return code, best


def assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, part), summed squared distances, and the rows themselves, in longs where nothing can overflow one."""
    n, parts, size = x.shape
    top = max(largest(x), max((abs(c) for book in books for entry in book for c in entry), default=0))
    whole = x.dtype != object and (2 * top * max(1, size)) ** 2 * parts < 1 << 62
    x = x if whole else x.astype(object)
    codes, error = np.zeros((n, parts), np.int64), np.zeros(n, x.dtype)
    for p, book in enumerate(books):
        table = np.array(book, np.int64 if whole else object).reshape(len(book), size)
        codes[:, p], distance = nearest_entries(x[:, p], table)
        error = error + distance
    return codes, error, x


def parts_of(batch: pa.RecordBatch, parts: int, size: int, scale: int) -> np.ndarray:
    """The vectors of a batch as whole numbers by (row, part, place), padded with zeros."""
    return integers(matrix(batch.column("vec"), parts * size), scale).reshape(-1, parts, size)


def next_books(rows: DataFrame, books: Books, size: int, scale: int) -> Books:
    """One round: every entry becomes the floor of its members' mean; an entry without members stays."""
    parts, entries = len(books), len(books[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, size + 1), object)
        for batch in batches:
            codes, _, x = assigned(parts_of(batch, parts, size, scale), books)
            for p in range(parts):
                for e in range(entries):
                    members = x[codes[:, p] == e, p]
                    totals[p, e, :size] += members.sum(0)
                    totals[p, e, size] += len(members)
        yield limb_batch((i, int(t)) for i, t in enumerate(totals.ravel()))

    found = added(rows.select("vec").mapInArrow(scan, LIMBS))
    out = []
    for p, book in enumerate(books):
        first = [(p * entries + e) * (size + 1) for e in range(entries)]
        out.append([[found[at + j] // found[at + size] for j in range(size)] if found[at + size] else book[e] for e, at in enumerate(first)])
    return out


def compressed(
    vectors: DataFrame, keep: tuple[str, ...], parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding"
) -> Codes:
    """Codes of all usable vectors; columns in ``keep`` go along as ``row``, others are not read.

    Vectors that are null or hold null or non-finite components take no part; shorter ones, and the last part, count as padded
    with zeros. Every component x counts as floor(scale * x). Codebooks start with the parts of the ``entries`` smallest ids
    (null ids last, equal ids by their vector), fewer where there are fewer rows. ``error`` is exact as decimal(38, 0), null
    beyond 38 digits. Repeated rows are all kept. An empty table gives no rows and no entries.
    """
    rows = vectors.filter(finite(F.col(vec_col))).select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    size = -(-width(rows, "vec") // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).toArrow()
    start = [parts_of(b, parts, size, scale) for b in first.to_batches()]
    books = [[[int(c) for c in line[p]] for block in start for line in block] for p in range(parts)]
    for _ in range(rounds if books[0] else 0):
        books = next_books(rows, books, size, scale)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error, _ = assigned(parts_of(batch, parts, size, scale), books)
            lists = pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists, decimals(error)], names=["row", "codes", "error"])

    schema = T.StructType().add(rows.schema["row"]).add("codes", T.ArrayType(T.IntegerType())).add("error", T.DecimalType(38, 0))
    return Codes(rows.select("row", "vec").mapInArrow(finish, schema), books)


def hex_code(codes: str) -> F.Column:
    """The codes in part order, two lower-case hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``, the errors of all rows with the same label added up, nulls being one label; null beyond 38 digits.

    Rows of a label with more rows than an average shuffle partition meet its sum by broadcast: there are fewer such labels
    than partitions. All others are joined by a shuffle, in which no label is large.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("label_", F.col(f"row.{label}")), "vector-codes")
    sums = written(rows.groupBy("label_").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows_")), "label-errors")
    part = sums.agg(F.sum("rows_") / partitions(spark)).scalar()
    sums = sums.withColumn("hot", F.col("rows_") > part).withColumnRenamed("label_", "of")
    same = F.col("label_").eqNullSafe(F.col("of"))
    hot = sums.where("hot").select("of", "label_error")
    marked = rows.join(F.broadcast(hot.withColumn("found", F.lit(True))), same, "left")
    columns = [*rows.columns, "label_error"]
    rest = marked.where("found IS NULL").drop("of", "label_error", "found").join(sums.where("NOT hot").select("of", "label_error"), same, "left")
    return marked.where("found").select(*columns).unionByName(rest.select(*columns)).drop("label_")
