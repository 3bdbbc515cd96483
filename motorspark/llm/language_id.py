"""Language identification by words first, backing off to character n-grams.

A word that the training texts know in any language counts with the logarithm of its relative frequency in each language. A
word that none of them knows falls back to its character n-grams, the longest length first: the first length of which the
training texts know any n-gram gives the mean of those. A language that lacks a word or n-gram counts a tenth of the rarest
frequency there can be. A text's language has the best mean over its words.

Counts cover all training rows and the dictionary may be of any size, so it is never gathered in one place. Texts are read
once into blocks: a block holds some 48 MB of texts, or one longer text, as bags over its own sorted dictionary. A block asks for each of its words
once, and the same shuffle by 64-bit hash carries its counts; the answers go back to the block. So even the most frequent word
has one row per block in any shuffle, and the longest group is as long as the list of blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.llm.common import held, partitions, written

#: Letters of the longest n-gram; longer runs of letters than MOST are read as several words.
LONGEST, MOST = 4, 1000
#: Characters worked on at a time, bytes of text per block.
CHUNK, BLOCK = 1 << 20, 48 << 20
#: An ask's ``at`` is block * PLACES + place, the last place standing for no answer wanted; ``counted`` is language * COUNTS + n.
PLACES, COUNTS = 1 << 28, 1 << 40
#: Blocks that one task may make.
TASK = 1 << 12
ODD = np.uint64(0x9E3779B97F4A7C13)
ASKS = "hash long, at long, counted long"
ANSWERED = ["block", "steps", "langs", "low", "high"]
ANSWERS = "block long, steps binary, langs binary, low binary, high binary"
LOW = (1 << 31) - 1
UNKNOWN = "und"


@dataclass(frozen=True)
class Tables:
    """Per code point: inside a word, a letter, random bits; powers of an odd number and of its inverse modulo 2^64."""

    inside: np.ndarray
    letter: np.ndarray
    bits: np.ndarray
    powers: np.ndarray
    inverse: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def make_tables() -> Tables:
    points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    marks = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in points), bool, len(points))
    bits = mixed(np.arange(1, len(points) + 1, dtype=np.uint64) * ODD)
    size = CHUNK * 2 + 2 * MOST
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    steps = np.ones(size, np.uint64)
    steps[1:] = ODD
    back = np.ones(size, np.uint64)
    back[1:] = inverse
    return Tables(letter | marks, letter, bits, np.multiply.accumulate(steps), np.multiply.accumulate(back))


def tables() -> Tables:
    return held("language tables", make_tables)


# --- words of texts ---


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most ``CHUNK`` characters, cut between words, or in a longer run after whole words of ``MOST``."""
    inside, at = tables().inside, 0
    while len(text) - at > CHUNK:
        stop = at + CHUNK
        while stop > at and inside[ord(text[stop])] and inside[ord(text[stop - 1])]:
            stop -= 1
        if stop == at:
            stop = at + CHUNK // MOST * MOST
        yield text[at:stop]
        at = stop
    yield text[at:]


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and lower-cased pieces, about ``CHUNK`` characters at a time."""
    rows, found, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces((text or "").lower()):
            if size + len(piece) > CHUNK and rows:
                yield rows, found
                rows, found, size = [], [], 0
            rows.append(row)
            found.append(piece)
            size += len(piece) + 1
    if rows:
        yield rows, found


def spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the array starts and ends outside a word."""
    edges = np.flatnonzero(np.diff(tables().inside[codes].astype(np.int8))) + 1
    starts, ends = edges[::2], edges[1::2]
    times = -(-(ends - starts) // MOST)
    if (times > 1).any():
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, ends = np.repeat(starts, times) + place * MOST, np.repeat(ends, times)
        ends = np.minimum(ends, starts + MOST)
    return starts, ends


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    t = tables()
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(t.bits[codes] * t.powers[: len(codes)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """64 bits for each span of characters and its kind: 0 for words, n for n-grams."""
    return mixed((sums[ends] - sums[starts]) * tables().inverse[starts] + np.uint64(kind * int(ODD) % 2**64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Bags:
    """A block as it fills: (text, word, times) of its texts, the numbers and letters of its words, which texts hold a letter."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.numbers: dict[int, int] = {}
        self.letters: list[str] = []
        self.lettered = np.zeros(0, bool)

    def add(self, owners: list[int], found: list[str]) -> None:
        codes = code_points("\n" + "\n".join(found) + "\n")
        starts, ends = spans(codes)
        lengths = np.fromiter((len(p) + 1 for p in found), np.int64, len(found))
        heads = np.cumsum(lengths) - lengths + 1
        owner = np.array(owners, np.int32)
        letters = np.add.reduceat(tables().letter[codes].astype(np.int32), heads) > 0
        np.logical_or.at(self.lettered, owner, letters)
        keys, first, which = np.unique(hashes(prefix_sums(codes), starts, ends, 0), return_index=True, return_inverse=True)
        text, number = code_text(codes), np.empty(len(keys), np.int32)
        for at, (key, s, e) in enumerate(zip(keys.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
            known = self.numbers.setdefault(key, len(self.letters))
            if known == len(self.letters):
                self.letters.append(text[s:e])
            number[at] = known
        place = np.searchsorted(heads, starts, side="right") - 1
        pair, times = np.unique(owner[place] * max(1, len(keys)) + which, return_counts=True)
        self.rows.append((pair // max(1, len(keys))).astype(np.int32))
        self.words.append(number[pair % max(1, len(keys))] if len(pair) else number)
        self.times.append(times.astype(np.int32))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, places and times in order, a pair once, and the words by place: frequent words have small places."""
        row, word, times = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.rows, self.words, self.times))
        by_size = np.argsort(-np.bincount(word, minlength=len(self.letters)), kind="stable")
        rank = np.empty(len(by_size), np.int32)
        rank[by_size] = np.arange(len(by_size))
        pair = row.astype(np.int64) * max(1, len(by_size)) + rank[word]
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        pair, times = pair[heads], np.add.reduceat(times.astype(np.int64), heads) if len(heads) else times
        return (pair // max(1, len(by_size))).astype(np.int32), (pair % max(1, len(by_size))).astype(np.int32), times, by_size


def code_text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=9)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2^31, each byte of them in a plane of its own, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + codec().compress(planes.tobytes(), asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(codec().decompress(data[8:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def block_schema(row: T.StructField) -> T.StructType:
    binary = T.BinaryType()
    schema = T.StructType().add("block", T.LongType()).add("rows", T.ArrayType(row.dataType)).add("langs", T.ArrayType(T.IntegerType()))
    for name in ("lettered", "sizes", "steps", "times", "words"):
        schema = schema.add(name, binary)
    return schema


def to_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(row, lang, text) as blocks: the rows, their languages, whether they hold a letter, and their bags of words.

    A bag is a run of (place in the block's dictionary, times); places are stored as steps.
    """

    def block(number: int, kept: list, langs: list, bags: Bags) -> pa.RecordBatch:
        row, place, times, by_size = bags.table()
        steps = np.diff(place, prepend=0)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        steps[first] = place[first]
        texts = "\n".join([bags.letters[k] for k in by_size.tolist()]).encode()
        n = len(bags.lettered)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), listed(pa.concat_arrays(kept)), listed(pa.concat_arrays(langs)),
                pa.array([squeezed(bags.lettered)], pa.binary()), pa.array([squeezed(np.bincount(row, minlength=n))], pa.binary()),
                pa.array([squeezed(steps)], pa.binary()), pa.array([squeezed(np.minimum(times, 2**31 - 1))], pa.binary()),
                pa.array([len(texts).to_bytes(8, "little") + codec().compress(texts, asbytes=True)], pa.binary()),
            ],
            names=["block", "rows", "langs", "lettered", "sizes", "steps", "times", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * TASK
        kept: list = []
        langs: list = []
        bags, size = Bags(), 0
        for batch in batches:
            at = 0
            column = batch.column("text").cast(pa.large_string())
            long = np.asarray(pc.fill_null(pc.binary_length(column), 0))
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(long[at:]), block_bytes - size, side="right"))
                stop = min(batch.num_rows, at + max(1, room))
                before = len(bags.lettered)
                bags.lettered = np.concatenate([bags.lettered, np.zeros(stop - at, bool)])
                for owners, found in chunks(column.slice(at, stop - at).to_pylist()):
                    bags.add([before + o for o in owners], found)
                kept.append(batch.column("row").slice(at, stop - at))
                langs.append(batch.column("lang").slice(at, stop - at))
                size += int(long[at:stop].sum())
                if size >= block_bytes or stop < batch.num_rows:
                    yield block(number, kept, langs, bags)
                    number, kept, langs = number + 1, [], []
                    bags, size = Bags(), 0
                at = stop
        if kept:
            yield block(number, kept, langs, bags)

    return rows.mapInArrow(run, block_schema(rows.schema["row"]))


def listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# --- a block read back ---


@dataclass(frozen=True)
class Block:
    langs: np.ndarray
    lettered: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    times: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def seen(self) -> np.ndarray:
        """Words that occur in a training text of this block: they are known, whatever the other blocks hold."""
        seen = np.zeros(len(self.starts), bool)
        seen[self.place[self.langs[self.owner] >= 0]] = True
        return seen


def read_block(row: dict) -> Block:
    sizes, steps = unsqueezed(row["sizes"]), unsqueezed(row["steps"])
    total = np.cumsum(steps, dtype=np.int64)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    if len(first):
        total -= np.repeat(total[first] - steps[first], sizes[sizes > 0])
    langs = np.array([-1 if x is None else x for x in row["langs"]], np.int32)
    words = row["words"]
    text = codec().decompress(words[8:], int.from_bytes(words[:8], "little"), asbytes=True).decode()
    codes = code_points("\n" + text + "\n")
    edges = np.flatnonzero(codes == 10)
    starts, ends = (edges[:-1] + 1, edges[1:]) if text else (edges[:0], edges[:0])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return Block(langs, unsqueezed(row["lettered"]) > 0, owner, total.astype(np.int32), unsqueezed(row["times"]), codes, starts, ends)


def in_runs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words that together stay within the tables of powers."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        yield first, last
        first = last


def word_hashes(block: Block) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for a, b in in_runs(block.starts, block.ends):
        low, high = block.starts[a] - 1, block.ends[b - 1] + 1
        out.append(hashes(prefix_sums(block.codes[low:high]), block.starts[a:b] - low, block.ends[a:b] - low, 0))
    return np.concatenate(out)


def grams(block: Block, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every n-gram of the chosen words; from two letters on, the ends of a word count as a character."""
    words, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    pad = int(n > 1)
    for a, b in in_runs(block.starts, block.ends):
        mine = chosen[(chosen >= a) & (chosen < b)]
        if not len(mine):
            continue
        low, high = block.starts[a] - 1, block.ends[b - 1] + 1
        sums = prefix_sums(block.codes[low:high])
        count = np.maximum(0, block.ends[mine] - block.starts[mine] + 2 * pad - n + 1)
        word = np.repeat(mine.astype(np.int32), count)
        place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + block.starts[word] - pad - low
        words.append(word)
        keys.append(hashes(sums, place, place + n, n))
    return np.concatenate(words), np.concatenate(keys)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weights, heads) if len(keys) else weights


def asked_grams(block: Block) -> np.ndarray:
    """Hashes of all n-grams of the words that no training text of the block holds, in their order."""
    unseen = np.flatnonzero(~block.seen)
    return np.unique(np.concatenate([grams(block, unseen, n)[1] for n in range(1, LONGEST + 1)]))


# --- counts and answers ---


def asks(blocks: DataFrame) -> DataFrame:
    """One row per block and word or n-gram and language it stands in; ``place`` where the block wants an answer, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = read_block(row)
                words, seen = word_hashes(block), block.seen
                asked = np.zeros(len(words), bool)
                spoken = block.langs[block.owner]
                for lang in np.unique(block.langs[block.langs >= 0]).tolist():
                    mine = spoken == lang
                    weight = np.bincount(block.place[mine], weights=block.times[mine], minlength=len(words)).astype(np.int64)
                    place = np.flatnonzero(weight)
                    n = weight[place]
                    yield ask(row["block"], words[place], np.where(asked[place], -1, place), lang, n)
                    asked[place] = True
                    for size in range(1, LONGEST + 1):
                        word, key = grams(block, place, size)
                        key, n = summed(key, weight[word])
                        yield ask(row["block"], key, np.full(len(key), -1), lang, n)
                rest = np.flatnonzero(~seen)
                yield ask(row["block"], words[rest], rest, -1, np.zeros(len(rest), np.int64))
                other = asked_grams(block)
                yield ask(row["block"], other, len(words) + np.arange(len(other)), -1, np.zeros(len(other), np.int64))

    return blocks.drop("rows").mapInArrow(run, ASKS)


def ask(block: int, key: np.ndarray, place: np.ndarray, lang: int, n: np.ndarray) -> pa.RecordBatch:
    at = block * PLACES + np.where(place < 0, PLACES - 1, place).astype(np.int64)
    counted = n.astype(np.int64) + max(lang, 0) * COUNTS
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(at), pa.array(counted)], names=["hash", "at", "counted"])


def answered(asked: DataFrame) -> DataFrame:
    """For every asking place of a block: the languages that hold its hash, with their counts over all blocks."""

    def packed(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, at, counted = (np.concatenate(c) for c in zip(*parts, strict=True))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        known = np.flatnonzero(counted % COUNTS)
        lang, n = counted[known] // COUNTS, counted[known] % COUNTS
        width = int(lang.max(initial=0)) + 1
        pair, total = summed(group[known] * width + lang, n)
        per_group = np.bincount(pair // width, minlength=int(group[-1]) + 1)
        first = np.cumsum(per_group) - per_group
        wants = np.flatnonzero(at % PLACES != PLACES - 1)
        wants = wants[np.argsort(at[wants], kind="stable")]
        times = per_group[group[wants]]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group[wants]], times)
        to, place = np.repeat(at[wants] // PLACES, times), np.repeat(at[wants] % PLACES, times)
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = total[entry[a:b]]
            cells = [np.diff(place[a:b], prepend=0), pair[entry[a:b]] % width, n & LOW, n >> 31]
            for column, value in zip(columns, [int(to[a]), *map(squeezed, cells)], strict=True):
                column.append(value)
        if columns[0]:
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=ANSWERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(c)) for c in ("hash", "at", "counted")]
            # rows of the batch's last hash wait for the next one
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            if rows >= 1 << 19 and (cut or parts[-1][0][-1] != columns[0][0]):
                yield from packed([*parts, [c[:cut] for c in columns]])
                parts, rows = [], 0
                columns = [c[cut:] for c in columns]
            parts.append(columns)
            rows += len(columns[0])
        if parts:
            yield from packed(parts)

    count = partitions(asked.sparkSession)
    return asked.repartition(count, "hash").sortWithinPartitions("hash").mapInArrow(run, ANSWERS)


def totals(blocks: DataFrame, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Words per language, and n-grams per language and length: a row per language and length reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((LONGEST + 1, languages), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = read_block(row)
                lang = block.langs[block.owner]
                known = lang >= 0
                times, lang = block.times[known], lang[known]
                length = (block.ends - block.starts)[block.place[known]]
                np.add.at(out[0], lang, times)
                for n in range(1, LONGEST + 1):
                    np.add.at(out[n], lang, times * np.maximum(0, length + 2 * (n > 1) - n + 1))
        yield pa.record_batch([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["cell", "n"])

    sums = np.zeros((LONGEST + 1) * languages, np.int64)
    for row in blocks.drop("rows").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[row.cell] = row.n
    sums = sums.reshape(LONGEST + 1, languages)
    return sums[0], sums[1:]


# --- scores ---


def block_scores(block: Block, places: np.ndarray, langs: np.ndarray, counts: np.ndarray, words: np.ndarray, by_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's best language and its share, from the answers to the block's words and n-grams."""
    size, languages = len(block.starts), len(words)
    known = np.zeros(size, bool)
    known[places[places < size]] = True
    unknown = np.flatnonzero(~known)
    other = asked_grams(block)
    found_gram = np.zeros(len(other), bool)
    found_gram[places[places >= size] - size] = True
    # each unknown word's n-grams of the first length of which any is known
    left, steps = unknown, []
    for n in range(LONGEST, 0, -1):
        word, key = grams(block, left, n)
        gram = np.searchsorted(other, key)
        has = found_gram[gram] if len(gram) else np.zeros(0, bool)
        steps.append((n, word[has], gram[has]))
        left = left[~np.isin(left, word[has])]
    log_words, log_grams = np.log10(np.maximum(words, 1)), np.log10(np.maximum(by_length, 1))
    tokens = np.bincount(block.owner, weights=block.times, minlength=len(block.langs))
    cost = np.zeros((languages, len(block.langs)))
    for g in range(languages):
        mine = langs == g
        place, n_times = places[mine], counts[mine]
        value = np.full(size, 1 + log_words.max())
        own = place < size
        value[place[own]] = log_words[g] - np.log10(n_times[own])
        for n, word, gram in steps:
            lacking = 1 + log_grams[n - 1].max()
            each = np.full(len(other), lacking)
            each[place[~own] - size] = log_grams[n - 1, g] - np.log10(n_times[~own])
            value[np.unique(word)] = 0
            np.add.at(value, word, each[gram] / np.bincount(word, minlength=size)[word])
        cost[g] = np.bincount(block.owner, weights=block.times * value[block.place], minlength=len(block.langs)) / np.maximum(tokens, 1)
    best = cost.argmin(0)
    share = 1 / (10.0 ** (cost.min(0) - cost)).sum(0)
    return best, share


def scored(blocks: DataFrame, answers: DataFrame, languages: list[str], words: np.ndarray, by_length: np.ndarray) -> DataFrame:
    row = blocks.schema["rows"].dataType.elementType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answer = {name: [unsqueezed(x.as_py()) for x in right.column(name)] for name in ANSWERED[1:]}
        none = [np.zeros(0, np.int64)]
        places = np.concatenate([np.cumsum(x, dtype=np.int64) for x in answer["steps"]] or none)
        langs = np.concatenate(answer["langs"] or none)
        counts = np.concatenate([low + (high.astype(np.int64) << 31) for low, high in zip(answer["low"], answer["high"], strict=True)] or none)
        given = left.drop_columns(["rows"]).to_pylist()
        for at, each in enumerate(given):
            block = read_block(each)
            best, share = block_scores(block, places, langs, counts, words, by_length)
            rows = left.column("rows")[at].values
            named = [languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), block.lettered.tolist(), strict=True)]
            out.append(pa.table([rows, pa.array(named, pa.string()), pa.array(np.where(block.lettered, share, 0.0))], names=["row", "lang_pred", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], left.schema.field("rows").type.value_type), pa.array([], pa.string()), pa.array([], pa.float64())], names=["row", "lang_pred", "score"])

    schema = T.StructType().add("row", row).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def identified(
    docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK
) -> DataFrame:
    """One row per document: ``row`` with the columns in ``keep``, ``lang_pred``, ``score`` from 0 to 1.

    Learned are the languages and all words of the rows where ``learn`` is true and the language is not null. A prediction
    reads the text alone. Words are runs of letters and marks, lower-cased. Null texts, empty ones and such without a letter
    give ``und`` and 0, and so does every text if nothing was learned; a text of which nothing is known gives the
    language with the most training rows, as does a tie. Repeated rows are predicted each, texts are read whole. Other columns
    are not read. The list of languages is held on the driver, a number per language and length.
    """
    known = docs.select(learn.alias("learn"), F.col(lang_col).alias("lang")).where("learn AND lang IS NOT NULL")
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r.lang for r in found]
    if not languages:
        return docs.select(F.struct(*keep).alias("row"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    numbers = spark.createDataFrame(list(enumerate(languages)), "number int, name string")
    rows = docs.select(F.struct(*keep).alias("row"), learn.alias("learn"), F.col(lang_col).alias("name"), F.col(text_col).alias("text"))
    # the list of languages is as long as the driver's
    rows = rows.join(F.broadcast(numbers), "name", "left").select("row", F.when(F.col("learn"), F.col("number")).alias("lang"), "text")
    blocks = written(to_blocks(rows, block_bytes), "language-blocks")
    words, by_length = totals(blocks, len(languages))
    return scored(blocks, answered(asks(blocks)), languages, words, by_length)
