"""Token ids as files: canonical length-limited Huffman codes in blocks that decode on their own.

A folder holds ``codes`` (id, bits: the code lengths, from which the canonical codes follow) and ``blocks``. A block row
holds whole documents in ascending order: their ids, numbers of tokens, and one stream of bits, each document from a new
byte; and for every ``CHECKPOINT`` ids the bit where they begin. Decoding looks up a table by the next ``max_bits`` bits,
and goes from all checkpoints of a block at once. Both parts are Parquet, so Spark commits, splits and reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.llm.chunks import encoder, portions
from motorspark.llm.common import new_path, partitions, written

CHECKPOINT = 256
BLOCK_IDS = 1 << 19
MAX_BITS = 18
TOKENS = "id long, n int, ids binary"
BLOCKS = "shard int, block int, before long, doc_ids array<long>, counts array<int>, n_ids long, marks binary, bits binary"


def token_ids(docs: DataFrame, path: str, end: int, spaces: bool, id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> DataFrame:
    """(id, n, ids) of every whole text (null: empty), closed by ``end``; ids are 16-bit where the vocabulary allows, else 32-bit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, spaces, specials)
        kind = np.uint16 if max(coder.vocabulary, end + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            for first, texts in portions(batch.column("text").to_pylist()):
                flat, counts = coder.encode(texts)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end).astype(kind)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind().itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
                yield pa.record_batch(
                    [batch.column("id").slice(first, len(texts)), pa.array((counts + 1).astype(np.int32)), ids.cast(pa.binary())],
                    names=["id", "n", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, TOKENS)


def wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype(np.uint32)


def flat_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of rows (n, ids) one after the other, as many rows at once as hold ids of one width."""
    column = batch.column("ids").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    narrow = np.diff(bounds) == 2 * np.asarray(batch.column("n"), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(narrow)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if bounds[a] < bounds[b]:
            yield np.frombuffer(column.buffers()[2], np.uint8)[bounds[a] : bounds[b]].view(np.uint16 if narrow[a] else np.uint32)


def id_counts(tokens: DataFrame) -> list[tuple[int, int]]:
    """(token id, places) over all documents: one row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for flat in flat_ids(batch):
                own = np.bincount(flat)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["token", "places"])

    counted = tokens.select("n", "ids").mapInArrow(count, "token long, places long")
    return [(r.token, r.places) for r in counted.groupBy("token").agg(F.sum("places").alias("places")).collect()]


def code_lengths(places: np.ndarray, most: int) -> np.ndarray:
    """Bits of each symbol by package-merge: the cheapest prefix code with no code longer than ``most``."""
    n = len(places)
    if n <= 2:
        return np.ones(n, np.int64)
    most = max(most, int(np.ceil(np.log2(n))))
    order = np.argsort(places, kind="stable")
    leaf = places[order].astype(np.float64)
    # one list a level, cheapest first; a merged entry knows how many leaves of the level below it takes
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([leaf, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    bits, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:taken].sum())
        bits[:leaves] += 1
        taken = 2 * (taken - leaves)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


def canonical(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The code of each symbol: codes rise with (bits, id)."""
    order = np.lexsort((tokens, bits))
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    for at in order.tolist():
        code <<= int(bits[at]) - last
        last = int(bits[at])
        codes[at] = code
        code += 1
    return codes


def pack_bits(codes: np.ndarray, bits: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One stream of the codes, each document (its codes end at ``ends``) from a new byte.

    Returns the stream's bytes, the bit where each code begins, and the byte where each document begins and the last ends.
    """
    before = np.concatenate([[0], np.cumsum(bits)])
    own = before[ends] - before[np.concatenate([[0], ends[:-1]])]
    firsts = np.concatenate([[0], np.cumsum((own + 7) // 8)])
    counts = np.diff(np.concatenate([[0], ends]))
    begin = before[:-1] + np.repeat(8 * firsts[:-1] - (np.cumsum(own) - own), counts)
    word, shift = begin >> 5, (begin & 31).astype(np.uint64)
    value = codes << (np.uint64(64) - bits.astype(np.uint64) - shift)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    out = np.zeros(int(firsts[-1] + 7) // 4 + 2, np.uint64)
    if len(heads):
        merged = np.bitwise_or.reduceat(value, heads)
        out[word[heads]] |= merged >> np.uint64(32)
        out[word[heads] + 1] |= merged & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").view(np.uint8)[: firsts[-1]], begin, firsts


@lru_cache(maxsize=2)
def decode_table(tokens: bytes, bits: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """For every value of the next ``most`` bits: the id that begins there, and its bits."""
    ids, lengths = np.frombuffer(tokens, np.uint32), np.frombuffer(bits, np.int64)
    most = int(lengths.max()) if len(lengths) else 1
    order = np.lexsort((ids, lengths))
    reach = 1 << (most - lengths[order])
    symbol, size = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    symbol[: reach.sum()] = np.repeat(ids[order], reach)
    size[: reach.sum()] = np.repeat(lengths[order], reach)
    return most, symbol, size


def unpack_bits(stream: bytes, marks: np.ndarray, lanes: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: ``lanes`` ids follow each bit of ``marks``, and all lanes step together."""
    most, symbol, size = table
    padded = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    word = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    order = np.argsort(-lanes, kind="stable")
    at, left = marks[order].astype(np.int64), lanes[order]
    place = (np.cumsum(lanes) - lanes)[order]
    out = np.empty(int(lanes.sum()), np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))
        at, place = at[:live], place[:live]
        next_bits = (word[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)
        out[place + step] = symbol[next_bits]
        at = at + size[next_bits]
    return out


def lane_sizes(counts: np.ndarray) -> np.ndarray:
    """Ids from each checkpoint of documents of ``counts`` ids to the next one."""
    full = -(-counts // CHECKPOINT)
    out = np.full(int(full.sum()), CHECKPOINT, np.int64)
    last = np.cumsum(full)[full > 0] - 1
    out[last] = (counts - (full - 1) * CHECKPOINT)[full > 0]
    return out


def write_token_files(tokens: DataFrame, folder: str, max_bits: int = MAX_BITS) -> None:
    """Writes (id, n, ids) in ascending order of id into ``folder``.

    Null ids come first; rows with the same id follow each other by a hash of their tokens. An empty table makes empty files.
    """
    spark = tokens.sparkSession
    counted = sorted(id_counts(tokens))
    ids, places = np.array([c[0] for c in counted], np.uint32), np.array([c[1] for c in counted], np.int64)
    bits = code_lengths(places, max_bits)
    codes = canonical(ids, bits)
    top = int(ids.max()) + 1 if len(ids) else 1
    code_of, bits_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
    code_of[ids], bits_of[ids] = codes, bits
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch.column("n"), np.int64)
            raw = batch.column("ids").to_pylist()
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // BLOCK_IDS, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True):
                flat = np.concatenate([wide(x, n) for x, n in zip(raw[a:b], counts[a:b].tolist(), strict=True)])
                ends = np.cumsum(counts[a:b])
                stream, begin, firsts = pack_bits(code_of[flat], bits_of[flat], ends)
                body, starts = stream.tobytes(), ends - counts[a:b]
                marks = [(begin[s:e:CHECKPOINT] - 8 * f).astype(np.uint32).tobytes() for s, e, f in zip(starts, ends, firsts, strict=False)]
                yield pa.record_batch(
                    [batch.column("id").slice(a, b - a), batch.column("n").slice(a, b - a), pa.array(marks, pa.binary()),
                     pa.array([body[firsts[i] : firsts[i + 1]] for i in range(b - a)], pa.binary())],
                    names=["id", "n", "marks", "bits"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, before = TaskContext.get().partitionId(), 0, 0

        def block(rows: list[tuple], size: int) -> pa.RecordBatch:
            firsts = np.cumsum([0] + [len(r[3]) for r in rows])
            marks = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.int64) + 8 * f for r, f in zip(rows, firsts, strict=False)])
            cells = [shard, number, before, [r[0] for r in rows], [r[1] for r in rows], size, marks.tobytes(), b"".join(r[3] for r in rows)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "marks", "bits")), strict=True):
                held.append(row)
                size += row[1]
                if size >= BLOCK_IDS:
                    yield block(held, size)
                    held, size, number, before = [], 0, number + 1, before + size
        if held:
            yield block(held, size)

    streams = tokens.mapInArrow(compress, "id long, n int, marks binary, bits binary")
    order = [F.col("id").asc_nulls_first(), F.xxhash64("bits")]
    dealt = streams.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, ids) of every document in the files; ids are little-endian unsigned 32-bit, start counts all ids before."""
    codes = spark.read.schema("id long, bits int").parquet(f"{folder}/codes").orderBy("id").collect()  # at most one row an id of the vocabulary
    tokens, bits = np.array([c.id for c in codes], np.uint32).tobytes(), np.array([c.bits for c in codes], np.int64).tobytes()
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(tokens, bits)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = unpack_bits(row["bits"], np.frombuffer(row["marks"], np.int64), lane_sizes(counts), table)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]) * 4
                body = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.record_batch(
                    [pa.array(np.full(len(counts), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - counts),
                     pa.array(counts), body.cast(pa.binary())],
                    names=["shard", "id", "at", "n", "ids"],
                )

    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))  # one row a file
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    decoded = blocks.mapInArrow(decode, "shard int, id long, at long, n long, ids binary")
    # one row a file: as many as there were shuffle partitions
    return decoded.join(F.broadcast(shards), "shard").select("id", (F.col("offset") + F.col("at")).alias("start"), "n", "ids")


def through_files(docs: DataFrame, path: str, end: int, spaces: bool, id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> DataFrame:
    """Encodes, writes and reads back: (id, start, n, ids) in ascending order of id. Null texts are empty; other columns are not read."""
    folder = new_path(docs.sparkSession, "token-files")
    write_token_files(written(token_ids(docs, path, end, spaces, id_col, text_col, specials), "tokens"), folder)
    return read_token_files(docs.sparkSession, folder)
