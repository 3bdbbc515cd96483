"""Exact removal of repeated passages: every byte under a string of ``LENGTH`` bytes that also starts anywhere else.

1. Anchors. Of the 32-byte strings within each window of 200 bytes the one with the smallest hash (the first of equals)
   anchors the window. It depends on the window's bytes alone, so equal windows have equal anchors at equal places: they
   can only be found among the fragments (168 bytes before an anchor, 200 from it on) of equal anchors.
2. Spark counts the anchors. Those that occur once hold nothing repeated. Equal fragments, of copies and of runs that
   repeat within a text, are counted as one. An anchor with a single fragment left needs no comparison.
3. The fragments of the other anchors form collections of documents. The transform is built column by column from the
   end, one symbol of every document a round: the documents stay sorted by what follows the column, and the common
   prefixes of neighbours are brought up to date from the round before. A common prefix of 200 bytes or more marks both
   windows. Equal windows of one anchor start in the same column, so suffixes are only ordered against those of the same
   column; a column's part of the transform is dropped once the next one is made, and the sequential files between the
   steps are Spark's own sorted shuffle files.
4. The marked windows of a text are united, and their bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorspark.llm.common import partitions, release, written

LENGTH, GRAM = 200, 32
LEFT = LENGTH - GRAM  # most bytes of a window before its anchor
WIDTH = LEFT + LENGTH
#: An odd base for rolling hashes modulo 2^64, its inverse, and two odd factors to mix bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes hashed at once, and fragments of a collection.
SEGMENT = 1 << 21
COLLECTION = 1 << 14
#: Digests of copied texts that a task remembers; should it forget one, its fragments are cut again and dropped later.
REMEMBERED = 1 << 18
SCANNED = (
    "row long, key binary, size long, h array<long>, f array<long>, p array<int>, w array<int>, local_from array<long>, local_to array<long>"
)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", BASE), ("down", INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, by minima from the left and from the right of blocks of ``w``."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in ``data``: text, place in ``data``, hash and fragment hash of each anchor."""
    found = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        low, high = max(0, at - LEFT), min(len(data), at + SEGMENT + LENGTH + WIDTH)
        piece = data[low:high]
        up, down = powers(len(piece) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], dtype=np.uint64)])
        grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(piece) - GRAM + 1])
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        first = at - low
        windows = min(SEGMENT, len(data) - LENGTH + 1 - at)
        least = sliding_min(ranked[first : first + windows + LEFT], LEFT + 1)
        begin = at + np.arange(windows)
        text = np.searchsorted(starts, begin, side="right") - 1
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[begin + LENGTH <= ends[text]]
        place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
        owner = np.searchsorted(starts, place + low, side="right") - 1
        head, tail = np.maximum(starts[owner] - low, place - LEFT), np.minimum(ends[owner] - low, place + LENGTH)
        whole = (prefix[tail] - prefix[np.maximum(head, 0)]) * down[np.maximum(head, 0)]
        whole = mixed(whole + ((place - head) * 1024 + tail - head).astype(np.uint64) * MIX_1)
        found.append((owner, place + low, grams[place], whole))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.uint64))
    owner, place, gram, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    once = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else slice(None)  # a segment's last may be the next one's first
    return owner[once], place[once], gram[once], whole[once]


def lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its digest, its anchors (each fragment once, ``w`` times) and the spans under fragments it holds twice."""
    release()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            column = part.column("text").cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            buffer = column.buffers()[2]
            data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
            bounds = bounds - bounds[0]
            starts, ends, n = bounds[:-1], bounds[1:], len(column)
            owner, place, gram, whole = anchors(data, starts, ends)
            same = mixed(gram + mixed(whole + owner.astype(np.uint64)))
            _, leader, group, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            low = np.maximum(starts[owner], place - LEFT) - starts[owner]
            high = np.minimum(place, ends[owner] - LENGTH) + LENGTH - starts[owner]
            again = np.flatnonzero(times[group] > 1)
            fresh = np.concatenate([[True], (owner[again][1:] != owner[again][:-1]) | (low[again][1:] > high[again][:-1])])[: len(again)]
            heads = np.flatnonzero(fresh)
            tails = np.concatenate([heads[1:] - 1, [len(again) - 1]])[: len(heads)]
            leader = np.sort(leader)
            view = memoryview(data)
            yield pa.record_batch(
                [part.column("row"), pa.array([hashlib.md5(view[a:b]).digest() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array(ends - starts),
                 lists(owner[leader], n, gram[leader].view(np.int64), pa.int64()), lists(owner[leader], n, whole[leader].view(np.int64), pa.int64()),
                 lists(owner[leader], n, (place - starts[owner])[leader].astype(np.int32), pa.int32()), lists(owner[leader], n, times[group][leader].astype(np.int32), pa.int32()),
                 lists(owner[again][heads], n, low[again][heads], pa.int64()), lists(owner[again][heads], n, high[again][tails], pa.int64())],
                names=[c.split()[0] for c in SCANNED.split(", ")],
            )


def common_windows(symbols: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For documents given as columns (a column of ``symbols`` a round), sorted by bucket: which windows two of a bucket share.

    ``symbols`` is WIDTH x documents with 256 where a document has no byte; the result is (LEFT + 1) x documents.
    """
    n = symbols.shape[1]
    edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    rank = (np.cumsum(edge) * 512).astype(np.int32)
    order = np.arange(n)
    prefix = np.zeros(n + 1, np.int32)  # of each document and the one before it in the order
    marked = np.zeros((LEFT + 1, n), bool)
    for column in range(WIDTH - 1, -1, -1):
        key = rank + symbols[column][order]
        new = np.argsort(key, kind="stable")
        key = key[new]
        like = np.flatnonzero(key[1:] == key[:-1]) + 1
        grown = np.zeros(n + 1, np.int32)
        if len(like):
            # neighbours that begin alike: one more than the least common prefix on the way between their old places
            way = np.column_stack([new[like - 1] + 1, new[like] + 1]).ravel()
            grown[like] = np.minimum.reduceat(prefix, way)[::2] + 1
        prefix, order = grown, order[new]
        prefix[:n][edge] = -1
        if column <= LEFT:
            long = np.flatnonzero(prefix[:n] >= LENGTH)
            marked[column, order[long]] = True
            marked[column, order[long - 1]] = True
    return marked


def as_columns(cells: list[bytes], gaps: list[int]) -> np.ndarray:
    """Fragments as columns of symbols; a fragment lacks ``gap`` bytes at its head and the rest at its tail."""
    rows = np.full((len(cells), WIDTH), 256, np.int16)
    for row, cell, gap in zip(rows, cells, gaps, strict=True):
        row[gap : gap + len(cell)] = np.frombuffer(cell, np.uint8)
    return np.ascontiguousarray(rows.T)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of fragments that come sorted by (h, salt), and for buckets split into several collections the hash of each window."""

    def collection(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
        bucket = np.unique(np.array([r[0] for r in rows], np.int64) * 1_000_003 + np.array([r[1] for r in rows], np.int64), return_inverse=True)[1]
        marked = common_windows(as_columns([r[4] for r in rows], [r[5] for r in rows]), bucket)
        bits = np.packbits(marked, axis=0).T
        windows = []
        for i, r in enumerate(rows):
            out = []
            if r[3] > 1:  # the bucket lies in several collections
                for c in range(r[5], min(LEFT, r[5] + len(r[4]) - LENGTH) + 1):
                    text = r[4][c - r[5] : c - r[5] + LENGTH]
                    out.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True))
            windows.append(out)
        return pa.record_batch(
            [pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(windows, pa.list_(pa.int64())), pa.array([r[5] for r in rows], pa.int32())],
            names=["h", "f", "marks", "windows", "gap"],
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "salt", "f", "salts", "cell", "gap")), strict=True):
            if held and row[:3] == held[-1][:3]:
                continue  # a copy of the text, cut by another task
            if len(held) >= COLLECTION and row[:2] != held[-1][:2]:
                yield collection(held)
                held = []
            held.append(row)
    if held:
        yield collection(held)


def cut_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted fragments of each text; of the copies that a task meets only the first is cut."""
    release()
    cut: set[bytes] = set()
    names = ["h", "f", "salts", "salt", "cell", "gap"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    for batch in batches:
        rows = []
        for at, (text, key, copies) in enumerate(zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("key", "copies")), strict=True)):
            if copies > 1:
                if key in cut:
                    continue
                if len(cut) >= REMEMBERED:
                    cut.clear()
                cut.add(key)
            data, wanted = memoryview(text.as_buffer()) if text.is_valid else memoryview(b""), batch.column("wanted")[at].as_py()
            for w in wanted:
                head = max(0, w["p"] - LEFT)
                rows.append((w["h"], w["f"], w["salts"], w["f"] % w["salts"], data[head : w["p"] + LENGTH].tobytes(), head - (w["p"] - LEFT)))
            if len(rows) >= 10_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def covered(n: int, copied: bool, local: list[tuple[int, int]], marks: list[dict]) -> np.ndarray:
    """Ascending (from, to) of the maximal runs of bytes to remove."""
    if n < LENGTH:
        return np.zeros((0, 2), np.int64)
    if copied:
        return np.array([[0, n]])
    step = np.zeros(n + 1, np.int32)
    for a, b in local:
        step[a] += 1
        step[b] -= 1
    for m in marks:
        low, high = max(0, m["p"] - LEFT), min(m["p"], n - LENGTH)
        if m["every"]:
            step[low] += 1
            step[high + LENGTH] -= 1
        else:
            columns = m["cs"] if m["marks"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["marks"], np.uint8))[: LEFT + 1])
            start = np.asarray(columns, np.int64) + m["p"] - LEFT
            start = start[(start >= low) & (start <= high)]
            step[start] += 1
            step[start + LENGTH] -= 1
    inside = np.cumsum(step[:-1]) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return change.reshape(-1, 2)


def remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes = [], [], []
        texts = batch.column("text")
        others = zip(*(batch.column(c).to_pylist() for c in ("copies", "local", "marks")), strict=True)
        for text, (copies, local, marks) in zip(texts, others, strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs = covered(len(data), (copies or 1) > 1, [(x["a"], x["b"]) for x in local or []], marks or [])
            sizes.append(len(data))
            spans.append([{"from": int(a), "to": int(b)} for a, b in runs])
            edges = [0, *runs.ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(runs) else data)
        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.record_batch([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, span), left], names=["row", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), as_text: bool = False) -> DataFrame:
    """row (a struct of the columns ``keep``), n_bytes, spans (ascending runs of removed bytes) and kept (the bytes left).

    A text is its UTF-8 bytes (null: empty). A byte goes if it lies under a string of 200 bytes that starts at any other
    place of any text, the same text included; strings are judged on the input. Repeated rows are copies of each other,
    whatever their ids, so texts of 200 bytes or more that occur twice go whole. Shorter texts stay. ``as_text`` returns kept as a string
    without the halves of characters that a cut has left. Columns outside ``keep`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    clean = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = written(docs.select(F.monotonically_increasing_id().alias("row"), clean.alias("text")).mapInArrow(scan, SCANNED), "anchors")
    texts = scanned.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))

    # where anchors occur that occur twice, whatever the text
    places = scanned.select("row", F.explode(F.arrays_zip("h", "f", "p", "w")).alias("a")).select("row", "a.h", "a.f", "a.p", "a.w")
    # written, so that the join has exchanges of its own, which adaptive execution may split where an anchor is hot
    twice = written(places.groupBy("h").agg(F.sum("w").alias("times")).filter("times > 1").select("h"), "frequent")
    places = written(places.join(twice, "h"), "places")
    fragments = places.groupBy("h", "f").agg(F.sum("w").alias("times"), F.min(F.struct("row", "p")).alias("first"))
    fragments = written(fragments, "different-fragments")
    buckets = written(fragments.groupBy("h").agg(F.count(F.lit(1)).alias("different")), "buckets")
    fragments = written(fragments.join(buckets, "h"), "fragments")

    keyed = docs.select(F.struct(*keep).alias("row"), clean.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    # every copy of a text meets its wanted fragments here: a task cuts them once, and compare skips what other tasks cut
    salts = F.ceil(F.col("different") / COLLECTION).cast("int").alias("salts")
    wanted = (
        fragments.filter("different > 1").select(F.col("first.row").alias("row"), F.struct("h", "f", F.col("first.p").alias("p"), salts).alias("x"))
        .groupBy("row").agg(F.collect_list("x").alias("wanted"))
        .join(texts.select("row", "key", "copies"), "row").select("key", "copies", "wanted")
    )
    cells = keyed.join(wanted, "key").select("text", "key", "copies", "wanted").mapInArrow(cut_fragments, "h long, f long, salts int, salt int, cell binary, gap int")
    dealt = cells.repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "f")
    compared = written(dealt.mapInArrow(compare, "h long, f long, marks binary, windows array<long>, gap int"), "marks")

    # buckets too large for one collection: windows that occur in several of them
    window = compared.filter(F.size("windows") > 0).select("h", "f", "gap", F.posexplode("windows").alias("i", "hash"))
    window = window.select("h", "f", (F.col("i") + F.col("gap")).alias("c"), "hash")
    shared = window.groupBy("h", "c", "hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    across = window.join(shared, ["h", "c", "hash"]).groupBy("h", "f").agg(F.collect_set("c").alias("cs"))
    nothing = F.lit(b"\x00" * ((LEFT + 8) // 8))
    none = {"every": F.lit(False), "marks": F.lit(None).cast("binary"), "cs": F.lit(None).cast("array<int>")}
    single = fragments.filter("times = 1").select("h", "f")
    found = (
        fragments.filter("times > 1").select("h", "f").withColumns(none | {"every": F.lit(True)})
        .unionByName(compared.filter(F.col("marks") != nothing).join(single, ["h", "f"]).select("h", "f", "marks").withColumns({k: none[k] for k in ("every", "cs")}))
        .unionByName(across.join(single, ["h", "f"]).withColumns({k: none[k] for k in ("every", "marks")}))
    )
    of_rows = places.join(found, ["h", "f"]).groupBy("row").agg(F.collect_list(F.struct("p", "every", "marks", "cs")).alias("marks"))
    local = F.transform(F.arrays_zip("local_from", "local_to"), lambda x: F.struct(x.local_from.alias("a"), x.local_to.alias("b")))
    # what is known of each text, by the row that stands for it
    of_texts = (
        texts.join(scanned.select("row", local.alias("local")), "row").join(of_rows, "row", "left")
        .select("key", "copies", F.when(F.col("copies") == 1, F.col("local")).alias("local"), F.when(F.col("copies") == 1, F.col("marks")).alias("marks"))
    )
    joined = keyed.join(of_texts, "key", "left").select("row", "text", "copies", "local", "marks")
    row, kept = joined.schema["row"].dataType.simpleString(), "string" if as_text else "binary"
    return joined.mapInArrow(partial(remove, as_text=as_text), f"row {row}, n_bytes long, spans array<struct<from:bigint,to:bigint>>, kept {kept}")
