"""Best-fit packing of tokenized documents into sequences, by bin completion.

Tasks cut documents into pieces and number the pieces of each length. What the search needs is the count of each length:
at most one row a token of a sequence, whatever the size of the corpus. It completes a bin around the largest length left:
fillings that no other filling dominates are tried with the least waste first, a branch ends when its waste rules out a
better result than the best so far, and best-fit decreasing gives the first result to beat. A filling is used as often as
the counts allow, so a whole plan is at most one pattern a length. A piece finds its place by its number among the pieces
of its length: the number in its task plus the pieces of that length in earlier tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorspark.llm.chunks import encoder, portions
from motorspark.llm.common import written

Pattern = tuple[tuple[int, ...], int]  # the lengths of a sequence, largest first, and how many sequences have them
PIECES = "id long, piece int, start long, n int, ids binary, ids_crc32 long, part int, nth long"


def cut_lengths(total: int, size: int) -> list[int]:
    """Pieces of a document: ``size`` each, but for the first of a longer one."""
    if total <= size:
        return [total]
    rest = total % size
    return [rest] * (rest > 0) + [size] * (total // size)


def pieces_of(docs: DataFrame, path: str, end: int, size: int, spaces: bool, id_col: str, text_col: str, specials: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, seen = encoder(path, spaces, specials), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in portions(batch.column("text").to_pylist()):
                flat, counts = coder.encode(texts)
                flat = np.insert(flat, np.cumsum(counts), end).astype(np.uint32)
                body, at, rows = flat.tobytes(), 0, []
                for i, total in enumerate((counts + 1).tolist()):
                    start = 0
                    for piece, n in enumerate(cut_lengths(total, size)):
                        cells = body[4 * at : 4 * (at + n)]
                        rows.append((ids[first + i], piece, start, n, cells, zlib.crc32(cells), part, int(seen[n])))
                        seen[n] += 1
                        start, at = start + n, at + n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing needs fewer: total tokens, and for each k what lengths above size - k leave no room for (Martello and Toth)."""
    lengths = np.arange(size + 1)
    total = lengths * counts
    best = -(-int(total.sum()) // size)
    number, amount = np.cumsum(counts), np.cumsum(total)
    for k in range(1, size // 2 + 1):
        big = int(number[size] - number[size - k])
        middle, middle_sum = int(number[size - k] - number[size // 2]), int(amount[size - k] - amount[size // 2])
        small_sum = int(amount[size // 2] - amount[k - 1])
        best = max(best, big + middle + max(0, -(-(small_sum - (middle * size - middle_sum)) // size)))
    return best


def best_fit(counts: np.ndarray, size: int) -> list[Pattern]:
    """Best-fit decreasing, many equal pieces at a time."""
    open_bins: dict[int, Counter] = {}  # free tokens: patterns with that much room
    for length in range(size, 0, -1):
        left = int(counts[length])
        for free in sorted(f for f in open_bins if f >= length):
            # equal sequences take as many pieces as fit before a roomier one is touched
            while left and free >= length and open_bins.get(free):
                pattern, copies = next(iter(open_bins[free].items()))
                used = min(copies, left)
                open_bins[free][pattern] -= used
                if not open_bins[free][pattern]:
                    del open_bins[free][pattern]
                open_bins.setdefault(free - length, Counter())[(*pattern, length)] += used
                left -= used
        while left:
            each = size // length
            used, per = (left // each, each) if left >= each else (1, left)
            open_bins.setdefault(size - per * length, Counter())[(length,) * per] += used
            left -= used * per
    return [(p, c) for bins in open_bins.values() for p, c in bins.items()]


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the items of ``other`` fit into bins as large as the items of ``one``."""
    if not other:
        return True
    if sum(other) > sum(one) or len(other) > 8:
        return False
    tried = set()
    for i, room in enumerate(one):
        if room >= other[0] and room not in tried:
            tried.add(room)
            if dominates(tuple(sorted((*one[:i], room - other[0], *one[i + 1 :]), reverse=True)), other[1:]):
                return True
    return False


def fillings(counts: np.ndarray, room: int, most: int = 4) -> list[tuple[int, ...]]:
    """Undominated sets of the lengths left that go into ``room``, least waste first."""
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]  # fills the room alone: it dominates every other set
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    other = room - have
    pair = have[(counts[other] > 0) & (other <= have) & ((other < have) | (counts[have] > 1))]
    if len(pair):
        return [(int(a), room - int(a)) for a in pair[::-1][:most]]
    # sums that can be reached, as bits of one number, with the lengths up to each one
    mask, reach, steps = (1 << (room + 1)) - 1, 1, [1]
    for a in have.tolist():
        times, step = min(int(counts[a]), room // a), 1
        while times > 0:
            step = min(step, times)
            reach |= (reach << (a * step)) & mask
            times -= step
            step *= 2
        steps.append(reach)
    found = []
    total = reach.bit_length() - 1
    while total > 0 and len(found) < most:
        rest, chosen = total, []
        for i in range(len(have) - 1, -1, -1):
            a = int(have[i])
            for times in range(min(int(counts[a]), rest // a), -1, -1):
                if steps[i] >> (rest - times * a) & 1:
                    chosen += [a] * times
                    rest -= times * a
                    break
        found.append(tuple(chosen))
        reach &= (1 << total) - 1
        total = reach.bit_length() - 1
    return [f for i, f in enumerate(found) if not any(dominates(g, f) for g in found[:i])]


def bin_completion(counts: np.ndarray, size: int, nodes: int = 4000) -> list[Pattern]:
    """The pattern list of the fewest sequences found within ``nodes`` steps of the search."""
    best = best_fit(counts, size)
    fewest, bound = sum(c for _, c in best), lower_bound(counts, size)
    tokens = int((np.arange(size + 1) * counts).sum())
    left, plan, waste, steps = counts.copy(), [], 0, 0
    branches: list[list[tuple[int, ...]]] = []

    def undo() -> None:
        nonlocal waste
        pattern, copies = plan.pop()
        waste -= (size - sum(pattern)) * copies
        for a in pattern:
            left[a] += copies

    while fewest > bound and steps < nodes:
        if len(branches) == len(plan):  # a new node
            steps += 1
            longest = int(np.flatnonzero(left)[-1]) if left.any() else 0
            if not longest:
                used = sum(c for _, c in plan)
                if used < fewest:
                    best, fewest = list(plan), used
                branches.append([])
            elif waste > (fewest - 1) * size - tokens:
                branches.append([])  # even without more waste this is no better
            else:
                left[longest] -= 1
                branches.append([(longest, *f) for f in fillings(left, size - longest)])
                left[longest] += 1
        if branches[-1]:
            pattern = branches[-1].pop(0)
            copies = min(int(left[a]) // k for a, k in Counter(pattern).items())
            for a in pattern:
                left[a] -= copies
            waste += (size - sum(pattern)) * copies
            plan.append((pattern, copies))
        else:
            branches.pop()
            if not plan:
                break
            undo()
    return best


def slots(plan: list[Pattern], size: int) -> dict[int, np.ndarray]:
    """For each length, one row a pattern that holds it: first number, first sequence, pieces a sequence, offset of the first."""
    numbered, found, sequence = np.zeros(size + 1, np.int64), {}, 0
    for pattern, copies in plan:
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            found.setdefault(length, []).append((int(numbered[length]), sequence, per, offset))
            numbered[length] += per * copies
            offset += per * length
        sequence += copies
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def packed_documents(
    docs: DataFrame, path: str, end: int, size: int = 1024, spaces: bool = True, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True, specials: bool = False,
) -> DataFrame:
    """One row per piece: (id, piece, start, n, ids, ids_crc32, sequence_id, offset); without ``ids`` if ``with_ids`` is off.

    A document is its whole text's ids (null text: empty) and ``end``; only documents of more than ``size`` ids are cut, and
    but for the first all their pieces have ``size`` ids. ids are little-endian unsigned 32-bit. Sequences hold at most
    ``size`` ids, from offset 0 without gaps. Null ids and repeated rows are packed like any other; other columns are not
    read. An empty table gives no rows. ``specials``: a string of an added token in a text is its one id.
    """
    pieces = written(pieces_of(docs, path, end, size, spaces, id_col, text_col, specials), "pieces")
    by_part = pieces.groupBy("part", "n").agg(F.count(F.lit(1)).alias("here"))
    lengths = by_part.groupBy("n").agg(F.sum("here").alias("count")).collect()  # at most one row a length
    counts = np.zeros(size + 1, np.int64)
    for row in lengths:
        counts[row["n"]] = row["count"]
    places = slots(bin_completion(counts, size), size)
    earlier = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "n", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c), np.int64) for c in ("n", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own, table = order[a:b], places[int(length[order[a]])]
                row = table[np.searchsorted(table[:, 0], number[own], side="right") - 1]
                past = number[own] - row[:, 0]
                sequence[own] = row[:, 1] + past // row[:, 2]
                offset[own] = row[:, 3] + past % row[:, 2] * length[own]
            columns = [batch.column(c) for c in batch.schema.names if c != "number"]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(offset)], names=[*(c for c in batch.schema.names if c != "number"), "sequence_id", "offset"])

    columns = [c for c in ("id", "piece", "start", "n", "ids", "ids_crc32") if with_ids or c != "ids"]
    numbered = pieces.join(offsets, ["part", "n"]).select(*columns, (F.col("before") + F.col("nth")).alias("number"))
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
