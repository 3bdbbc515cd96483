"""Weighted terms and topics of a text column.

Terms are counted inside their row, so no (document, term) pair is ever shuffled: a sketch of bucket counts, which adds up over
tasks, rules out nearly all terms that are too rare, and only the others are counted exactly, many documents at a time. Where the
vocabulary is all that is wanted of the texts, their words are written as numbers once, two passes over these find it first, and
bags list its terms only. The kept vocabulary is a top-k list, small by construction. Topics come from a non-negative
factorisation whose passes run over the document rows in Arrow batches: a document's topic
weights depend only on its own terms and the k-by-terms topic matrix, and the sums that update
that matrix are added up by a distributed aggregation.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.functions import fixed_values as fixed
from motorspark.functions.text import letters_only
from motorspark.functions.values import longest_argument
from motorspark.session import checkpointed

# Tasks get this module's helpers with the function, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def default_stop_words() -> list[str]:
    """Spark's English stop words, both sides of an apostrophe, and the boilerplate of recall summaries."""
    english = [half for w in StopWordsRemover.loadDefaultStopWords("english") for half in w.split("'")]
    return sorted(set(english) | set(fixed.BOILERPLATE_WORDS))


def words(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of at least two letters that are no stop words, in order."""
    return F.filter(
        F.split(letters_only(text), " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words))
    )


def terms(tokens: Column, pairs: bool = True) -> Column:
    """The words and, with ``pairs``, every two neighbours joined by a blank."""
    if not pairs:
        return tokens
    count = F.greatest(F.size(tokens) - 1, F.lit(0))
    couples = F.zip_with(
        F.slice(tokens, F.lit(1), count), F.slice(tokens, F.lit(2), count), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(tokens, couples)


def term_counts(df: DataFrame, id_column: str, text: str, stop_words: Sequence[str], pairs: bool = True) -> DataFrame:
    """(document, term, tf) over whole texts.

    The outer explode keeps Spark from adding a size filter that would tokenise every text twice.
    """
    tokens = df.select(id_column, words(F.col(text), stop_words).alias("_words"))
    return (
        tokens.select(id_column, F.explode_outer(terms(F.col("_words"), pairs)).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(id_column, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(counts: DataFrame, documents: Column, min_df: int = 20, max_features: int = 2000) -> DataFrame:
    """The most frequent terms found in enough documents: ``term``, ``total``, ``df``, ``idf``.

    ``documents`` is the number of documents with text.
    """
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= min_df)
        .orderBy(F.col("total").desc(), "term")
        .limit(max_features)
        .withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)
    )


#: Bytes of text, and terms of documents, that a task works on at once.
MAX_TEXT, MAX_TERMS = 1 << 20, 1 << 19
#: Counts that a task holds before it adds them up.
MAX_COUNTS = 1 << 18
_LETTERS = bytes(b for b in range(256) if chr(b) in string.ascii_letters)
_OTHERS = bytes(b for b in range(256) if b not in _LETTERS)
_LOWER = bytes(range(256)).lower()
_IS_LETTER = bytes(b in _LETTERS for b in range(256))
#: The only other characters with a letter a-z in lower case.
_TO_LETTERS = {"\u0130": "i\u0307", "\u212a": "k"}


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows, as (first, number), of at most ``most`` in sum, or one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        taken = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, taken + most, side="right")))
        yield low, high - low
        low = high


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of a-z of texts without nulls, in lower case, and the text each is in."""
    def body(column: pa.Array) -> tuple[np.ndarray, bytes]:
        ends = _offsets(column)
        return ends, (column.buffers()[2] or pa.py_buffer(b""))[ends[0] : ends[-1]].to_pybytes()

    ends, raw = body(column)
    if not raw.isascii() and any(sign.encode() in raw for sign in _TO_LETTERS):
        for sign, low in _TO_LETTERS.items():
            column = pc.replace_substring(column, sign, low)
        ends, raw = body(column)
    on = np.frombuffer(raw.translate(_IS_LETTER), dtype=bool)
    ends = ends.astype(np.int64) - ends[0]
    borders = ends[(ends > 0) & (ends < len(on))]
    before, after = np.zeros(len(on), dtype=bool), np.zeros(len(on), dtype=bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    before[borders], after[borders - 1] = False, False
    starts = np.flatnonzero(on & ~before)
    sizes = np.flatnonzero(on & ~after) + 1 - starts
    words_ = pa.Array.from_buffers(pa.string(), len(starts), [None, _ends(sizes).buffers()[1], pa.py_buffer(raw.translate(_LOWER, _OTHERS))])
    return words_, np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, ends)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _coded(texts: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, and of every word that counts, in order, its text and its number."""
    words_, rows = _split(texts)
    coded = words_.dictionary_encode()
    known = coded.dictionary
    kept = np.asarray(pc.greater_equal(pc.binary_length(known), 2)) & ~np.asarray(pc.is_in(known, value_set=stop))
    codes = np.asarray(coded.indices, dtype=np.int64)
    counts = kept[codes]
    return known, rows[counts], codes[counts]


#: Ids of some texts, the words in them, and of every word that counts its text and its number.
_Coded = tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]


def _coded_texts(batches: Iterator[pa.RecordBatch], stop: pa.Array) -> Iterator[_Coded]:
    for batch in batches:
        for low, number in _slices(np.diff(_offsets(batch.column(1))), MAX_TEXT):
            yield batch.column(0).slice(low, number), *_coded(batch.column(1).slice(low, number), stop)


def _coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Coded]:
    def read(ids: pa.ListScalar, *cells: pa.BinaryScalar) -> _Coded:
        # copies: else a block's few words keep its whole batch while the next one is read
        sizes, codes, ends, letters = (pa.py_buffer(c.as_py()) for c in cells)
        sizes = np.frombuffer(sizes, dtype=np.int32)
        known = pa.Array.from_buffers(pa.string(), ends.size // 4 - 1, [None, ends, letters])
        codes = np.frombuffer(codes, dtype=np.uint16 if len(known) <= 1 << 16 else np.int32)
        return pa.concat_arrays([ids.values]), known, np.repeat(np.arange(len(sizes)), sizes), codes.astype(np.int64)

    for batch in batches:
        columns, number = batch.columns, batch.num_rows
        del batch
        for at in range(number):
            coded = read(*(c[at] for c in columns))
            if at + 1 == number:
                del columns
            yield coded


def word_blocks(df: DataFrame, id_column: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """The words of some documents a row, in order, as numbers into the row's different words. No rows are moved."""
    left_out = list(stop_words)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, known, rows, codes in _coded_texts(batches, pa.array(left_out, pa.string())):
            used = np.bincount(codes, minlength=len(known)) > 0
            known, codes = known.filter(pa.array(used)), (np.cumsum(used) - 1)[codes]
            ends = _offsets(known)
            letters = (known.buffers()[2] or pa.py_buffer(b""))[ends[0] : ends[-1]] if len(known) else pa.py_buffer(b"")
            sizes, ends = np.bincount(rows, minlength=len(ids)).astype(np.int32), (ends - ends[0] if len(known) else np.zeros(1)).astype(np.int32)
            cells = sizes, codes.astype(np.uint16 if len(known) <= 1 << 16 else np.int32), ends
            columns = [pa.array([c.tobytes()]) for c in cells] + [pa.array([letters.to_pybytes()])]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(_ends(np.array([len(ids)])), ids), *columns], names=["ids", "sizes", "codes", "ends", "letters"])

    schema = T.StructType().add("ids", T.ArrayType(df.schema[id_column].dataType))
    for name in ("sizes", "codes", "ends", "letters"):
        schema = schema.add(name, T.BinaryType())
    return df.select(id_column, _texts(text)).mapInArrow(block, schema)


def _bag(known: pa.Array, rows: np.ndarray, codes: np.ndarray, number: int, pairs: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Different terms per text: how many, the terms, and how often each occurs."""
    width = len(known)
    keys, all_rows = codes, rows
    if pairs:
        near = rows[1:] == rows[:-1]
        keys = np.concatenate([codes, width + codes[:-1][near] * width + codes[1:][near]])
        all_rows = np.concatenate([rows, rows[1:][near]])
    span = max(1, width + width * width)
    found, tfs = _distinct(all_rows * span + keys)
    rows, keys = found // span, found % span
    single = keys < width
    first = known.take(pa.array(np.where(single, keys, (keys - width) // max(1, width))))
    second = known.take(pa.array(np.where(single, keys, (keys - width) % max(1, width))))
    names = pc.if_else(pa.array(single), first, pc.binary_join_element_wise(first, second, " "))
    return np.bincount(rows, minlength=number), names, tfs


@dataclass(frozen=True)
class _Wanted:
    """Some terms by number, and the words they are made of."""

    terms: pa.Array
    words: pa.Array
    singles: np.ndarray
    keys: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, terms_: Sequence[str]) -> _Wanted:
        split = [t.split(" ") for t in terms_]
        place = {w: i for i, w in enumerate(sorted({w for parts in split for w in parts}))}
        singles = np.full(len(place) + 1, -1, dtype=np.int64)
        couples = []
        for number, parts in enumerate(split):
            if len(parts) == 1:
                singles[place[parts[0]]] = number
            elif len(parts) == 2:
                couples.append((place[parts[0]] * len(place) + place[parts[1]], number))
        couples = np.array(sorted(couples), dtype=np.int64).reshape(-1, 2)
        return cls(pa.array(list(terms_), pa.string()), pa.array(list(place), pa.string()), singles, couples[:, 0], couples[:, 1])

    def bag(self, known: pa.Array, rows: np.ndarray, codes: np.ndarray, number: int, pairs: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """``_bag`` of these terms alone."""
        places = _places(known, self.words)[codes]
        numbers = self.singles[places]
        if pairs and len(self.keys):
            near, keys = _neighbours(rows, places, len(self.words))
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            numbers = np.concatenate([numbers, np.where(self.keys[at] == keys, self.numbers[at], -1)])
            rows = np.concatenate([rows, rows[1:][near]])
        span = max(1, len(self.terms))
        found, tfs = _distinct((rows * span + numbers)[numbers >= 0])
        return np.bincount(found // span, minlength=number), self.terms.take(pa.array(found % span)), tfs


def _places(known: pa.Array, wanted: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.index_in(known, value_set=wanted), -1), dtype=np.int64)


def _neighbours(rows: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbours of a text both have a place, and the number of each such pair."""
    near = (rows[1:] == rows[:-1]) & (places[1:] >= 0) & (places[:-1] >= 0)
    return near, places[:-1][near] * width + places[1:][near]


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _texts(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")


def bags(
    df: DataFrame, id_column: str, text: str, stop_words: Sequence[str], pairs: bool = True,
    among: Sequence[str] | None = None, blocks: DataFrame | None = None,
) -> DataFrame:
    """One row per document: its different ``terms`` and how often each occurs, ``tfs``. No rows are moved.

    Terms are those of ``terms`` and ``words``, or those of them that are ``among`` a bounded list; a task works on few texts
    at once, however many a batch has. ``blocks``: the ``word_blocks`` of ``df`` where they are written; texts are not read then.
    """
    left_out, few, from_texts = list(stop_words), None if among is None else list(among), blocks is None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = _bag if few is None else _Wanted.of(few).bag
        for ids, known, rows, codes in _coded_texts(batches, pa.array(left_out, pa.string())) if from_texts else _coded_blocks(batches):
            sizes, names, tfs = bag(known, rows, codes, len(ids), pairs)
            ends = _ends(sizes)
            columns = [ids, pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "terms", "tfs"])

    schema = T.StructType().add(df.schema[id_column]).add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.IntegerType()))
    return (df.select(id_column, _texts(text)) if from_texts else blocks).mapInArrow(count, schema)


class _Sums:
    """Totals and numbers of documents by term, added up in a task as far as they fit."""

    def __init__(self, name: str):
        self.name, self.held, self.size = name, [], 0

    def added(self) -> pa.RecordBatch:
        coded = pa.concat_arrays([keys for keys, *_ in self.held]).dictionary_encode()
        which, width = np.asarray(coded.indices), len(coded.dictionary)
        sums = [np.bincount(which, np.concatenate([x[i] for x in self.held]), width).astype(np.int64) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(sums[0]), pa.array(sums[1])], names=[self.name, "total", "df"])

    def add(self, keys: pa.Array, totals: np.ndarray, dfs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, totals, dfs))
        self.size += len(keys)
        if self.size > MAX_COUNTS:
            batch = self.added()
            self.held, self.size = [], 0
            if 2 * len(batch) > MAX_COUNTS:
                yield batch
            else:
                self.held, self.size = [(batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2)))], len(batch)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self.added()


def likely_terms(blocks: DataFrame, min_df: int = 20, max_features: int = 2000, pairs: bool = True) -> list[str] | None:
    """The terms of ``vocabulary``, from two passes over ``word_blocks``; None if too many words are as frequent as the last one wanted.

    A pair is in no more documents, and no more often, than either of its words. So once there are ``max_features`` words in
    enough documents, both words of a wanted pair are at least as frequent as the last of these; only such pairs are counted.
    """

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums("term")
        for _, known, rows, codes in _coded_blocks(batches):
            span = max(1, len(known))
            totals, dfs = np.bincount(codes, minlength=span), np.bincount(_distinct(rows * span + codes)[0] % span, minlength=span)
            used = np.flatnonzero(totals)
            yield from sums.add(known.take(pa.array(used)), totals[used], dfs[used])
        yield from sums.rest()

    sums = F.sum("total").alias("total"), F.sum("df").alias("df")
    single = blocks.mapInArrow(count_words, "term string, total long, df long").groupBy("term").agg(*sums).where(F.col("df") >= min_df)
    found = single.orderBy(F.col("total").desc(), "term").limit(2 * max_features + 1).collect()
    least = found[max_features - 1]["total"] if len(found) >= max_features else 0
    if len(found) > 2 * max_features and found[-1]["total"] >= least:
        return None
    ranked = [(-r["total"], r["term"]) for r in found if r["total"] >= least]
    if pairs and ranked:
        # in order, as a blank comes before all letters: pairs by number are pairs by name
        names = sorted(term for _, term in ranked)
        width = len(names)

        def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, sums = pa.array(names, pa.string()), _Sums("pair")
            for _, known, rows, codes in _coded_blocks(batches):
                near, keys = _neighbours(rows, _places(known, wanted)[codes], width)
                cells, times = _distinct(rows[1:][near] * width**2 + keys)
                yield from sums.add(pa.array(cells % width**2), times, np.ones(len(cells), dtype=np.int64))
            yield from sums.rest()

        double = blocks.mapInArrow(count_pairs, "pair long, total long, df long").groupBy("pair").agg(*sums)
        double = double.where((F.col("df") >= min_df) & (F.col("total") >= least)).orderBy(F.col("total").desc(), "pair").limit(max_features)
        ranked += [(-r["total"], f"{names[r['pair'] // width]} {names[r['pair'] % width]}") for r in double.collect()]
    return [term for _, term in sorted(ranked)[:max_features]]


def _term_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Different terms of some documents at a time, with how often they occur and in how many documents."""
    for batch in batches:
        lists, tfs = batch.column("terms"), batch.column("tfs")
        for low, number in _slices(np.asarray(lists.value_lengths(), dtype=np.int64), MAX_TERMS):
            coded = lists.slice(low, number).flatten().dictionary_encode()
            codes = np.asarray(coded.indices, dtype=np.int64)
            totals = np.bincount(codes, np.asarray(tfs.slice(low, number).flatten(), dtype=np.float64), len(coded.dictionary))
            yield coded.dictionary, totals.astype(np.int64), np.bincount(codes, minlength=len(coded.dictionary))


def _buckets(names: pa.Array, buckets: int) -> np.ndarray:
    return (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)


def _sketch(counted: DataFrame, min_df: int, max_features: int, buckets: int) -> np.ndarray:
    """For each hash bucket, whether it may hold one of the wanted terms.

    A term occurs in no more documents, and no more often, than its bucket. Some terms are counted by every task, so these
    counts are at most the true ones: once there are ``max_features`` of them in enough documents, no wanted term is rarer
    than the last of these. A table of ``buckets`` lines and one of a few thousand counts per task are all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        watched, sums = None, np.zeros((2, 0), dtype=np.int64)
        for names, totals, dfs in _term_sums(batches):
            if not len(names):
                continue
            place = _buckets(names, buckets)
            np.add.at(total, place, totals)
            np.add.at(df, place, dfs)
            if watched is None:
                watched = names.take(pa.array(np.argsort(-totals, kind="stable")[: 2 * max_features]))
                sums = np.zeros((2, len(watched)), dtype=np.int64)
            at = np.asarray(pc.fill_null(pc.index_in(watched, value_set=names), -1), dtype=np.int64)
            sums[:, at >= 0] += np.stack([totals, dfs])[:, at[at >= 0]]
        filled = np.flatnonzero(df)
        none = pa.nulls(len(filled), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(filled), none, pa.array(total[filled]), pa.array(df[filled])], names=["bucket", "term", "total", "df"])
        if watched is not None:
            none = pa.nulls(len(watched), pa.int64())
            yield pa.RecordBatch.from_arrays([none, watched, pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "term", "total", "df"])

    lines = counted.select("terms", "tfs").mapInArrow(run, "bucket long, term string, total long, df long")
    summed = checkpointed(lines.groupBy("bucket", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_df))
    known = [r["total"] for r in summed.where("term is not null").orderBy(F.col("total").desc()).limit(max_features).select("total").collect()]
    least = known[-1] if known and len(known) == max_features else 0
    likely = np.zeros(buckets, dtype=bool)
    likely[np.asarray(summed.where(F.col("bucket").isNotNull() & (F.col("total") >= least)).select("bucket").toArrow().column(0), dtype=np.int64)] = True
    return likely


def frequent_terms(
    counted: DataFrame, documents: Column, min_df: int = 20, max_features: int = 2000, buckets: int = 1 << 18
) -> DataFrame:
    """The same table as ``vocabulary``, from ``bags``.

    Terms in hash buckets that cannot hold a wanted one are left out, the others are summed up for many documents at a time
    before they are moved. ``buckets`` 0 leaves none out, for bags of few different terms.
    """
    packed = np.packbits(_sketch(counted, min_df, max_features, buckets)) if buckets else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = np.unpackbits(packed, count=buckets).astype(bool) if buckets else None
        sums = _Sums("term")
        for names, totals, dfs in _term_sums(batches):
            if buckets and len(names):
                mine = np.flatnonzero(likely[_buckets(names, buckets)])
                names, totals, dfs = names.take(pa.array(mine)), totals[mine], dfs[mine]
            yield from sums.add(names, totals, dfs)
        yield from sums.rest()

    return (
        counted.select("terms", "tfs")
        .mapInArrow(run, "term string, total long, df long")
        .groupBy("term")
        .agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        .where(F.col("df") >= min_df)
        .orderBy(F.col("total").desc(), "term")
        .limit(max_features)
        .withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)
    )


def weighted_rows(counted: DataFrame, id_column: str, names: Sequence[str], idfs: Sequence[float]) -> DataFrame:
    """``bags`` as (id, ``term_ids``, ``weights``): numbers of the kept terms and tf-idf scaled to length one.

    Documents without a kept term are left out. Every row is worked out where it lies.
    """
    known, factors = list(names), np.array(idfs, dtype=np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.array(known, pa.string())
        for whole in batches:
            for low, count in _slices(np.asarray(whole.column("terms").value_lengths(), dtype=np.int64), MAX_TERMS):
                yield weighed(whole.slice(low, count), kept)

    def weighed(batch: pa.RecordBatch, kept: pa.Array) -> pa.RecordBatch:
        lists = batch.column("terms")
        sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
        number = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=kept), -1), dtype=np.int64)
        hit = number >= 0
        row, number = np.repeat(np.arange(len(sizes)), sizes)[hit], number[hit]
        weight = np.asarray(batch.column("tfs").flatten(), dtype=np.float64)[hit] * factors[number]
        order = np.argsort(row * len(known) + number)
        row, number, weight = row[order], number[order], weight[order]
        weight /= np.sqrt(np.bincount(row, weight**2, minlength=len(sizes)))[row]
        per_row = np.bincount(row, minlength=len(sizes))
        rows = np.flatnonzero(per_row)
        ends = _ends(per_row[rows])
        ids = batch.column(0).take(pa.array(rows))
        columns = [ids, pa.ListArray.from_arrays(ends, pa.array(number)), pa.ListArray.from_arrays(ends, pa.array(weight))]
        return pa.RecordBatch.from_arrays(columns, names=[id_column, "term_ids", "weights"])

    schema = T.StructType().add(counted.schema[id_column]).add("term_ids", T.ArrayType(T.LongType())).add("weights", T.ArrayType(T.DoubleType()))
    return counted.mapInArrow(weigh, schema)


def document_count(df: DataFrame, text: str) -> Column:
    return df.agg(F.count_if(F.col(text).rlike(f"[A-Za-z{''.join(_TO_LETTERS)}]"))).scalar()


def tfidf(counts: DataFrame, vocab: DataFrame, id_column: str) -> DataFrame:
    """One row per document: its terms and their weights, scaled to length one."""
    weighted = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select(
        id_column, "term", (F.col("tf") * F.col("idf")).alias("_w")
    )
    rows = weighted.groupBy(id_column).agg(
        F.sort_array(F.collect_list(F.struct("term", "_w"))).alias("_items"), F.sqrt(F.sum(F.col("_w") ** 2)).alias("_norm")
    )
    return rows.select(
        id_column,
        F.col("_items.term").alias("terms"),
        F.zip_with("_items._w", F.array_repeat("_norm", F.size("_items")), lambda w, n: w / n).alias("weights"),
    )


def long_weights(documents: DataFrame, id_column: str) -> DataFrame:
    """(document, term, weight)."""
    return documents.select(
        id_column, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight")))
    ).toDF(id_column, "term", "weight")


@dataclass
class Factors:
    """Topic matrix over the vocabulary, and the error after every round."""

    terms: list[str]
    topics: np.ndarray
    errors: list[float] = field(default_factory=list)


MAX_ENTRIES = 1 << 17


@dataclass(frozen=True)
class Block:
    """Some rows of a batch: where each row's entries start, term numbers and weights."""

    starts: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    held: dict[str, np.ndarray] = field(default_factory=dict)

    def dense(self, width: int) -> np.ndarray | None:
        """The rows as a matrix of at most 32 cells an entry; None if it would need more."""
        if 32 * len(self.ids) < len(self.starts) * width:
            return None
        if "dense" not in self.held:
            cells = np.repeat(np.arange(len(self.starts)) * width, np.diff(np.append(self.starts, len(self.ids)))) + self.ids
            self.held["dense"] = np.bincount(cells, self.weights, len(self.starts) * width).reshape(-1, width)
        return self.held["dense"]

    def times(self, right: np.ndarray) -> np.ndarray:
        """Rows times a terms-by-k matrix."""
        dense = self.dense(len(right))
        if dense is not None:
            return dense @ right
        return np.add.reduceat(self.weights[:, None] * right[self.ids], self.starts, axis=0)

    def transposed_times(self, own: np.ndarray, width: int) -> np.ndarray:
        """Transposed rows times a rows-by-k matrix."""
        dense = self.dense(width)
        if dense is not None:
            return dense.T @ own
        spread = np.repeat(own, np.diff(np.append(self.starts, len(self.ids))), axis=0) * self.weights[:, None]
        return np.stack([np.bincount(self.ids, spread[:, j], minlength=width) for j in range(own.shape[1])], axis=1)


def blocks(batch: pa.RecordBatch | pd.DataFrame) -> Iterator[tuple[slice, Block]]:
    """The batch in blocks of whole rows with a bounded number of entries; no row is empty."""
    ids, weights = (c if isinstance(c, pa.Array) else pa.array(c) for c in (batch["term_ids"], batch["weights"]))
    ends = np.cumsum(np.asarray(ids.value_lengths(), dtype=np.int64))
    ids, weights = np.asarray(ids.flatten()), np.asarray(weights.flatten())
    for low, number in _slices(np.diff(ends, prepend=0), MAX_ENTRIES):
        taken = ends[low - 1] if low else 0
        own = slice(taken, ends[low + number - 1])
        starts = np.append(taken, ends[low : low + number - 1]) - taken
        yield slice(low, low + number), Block(starts, ids[own], weights[own])


def topic_weights(cross: np.ndarray, square: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative weights of each row given topics: coordinate descent from zero."""
    weights = np.zeros_like(cross)
    for _ in range(sweeps):
        for j in range(square.shape[0]):
            if square[j, j] > 0:
                step = (cross[:, j] - weights @ square[:, j]) / square[j, j]
                weights[:, j] = np.maximum(weights[:, j] + step, 0)
    return weights


def exact_weights(cross: np.ndarray, square: np.ndarray, solved: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The non-negative weights of each row that fit best, by exchanging active sets of all rows at once.

    ``solved`` keeps inverses between calls with the same ``square``. Rows with the same set of positive weights are solved together. A row exchanges every weight that breaks a condition, and,
    when that does not help three times, only the last of them, which always ends.
    """
    n, k = cross.shape
    positive, weights, gradient = np.zeros((n, k), bool), np.zeros((n, k)), -cross
    tries, fewest = np.full(n, 3), np.full(n, k + 1)
    small = 1e-12 * max(1.0, float(np.abs(cross).max(initial=0.0)))
    for _ in range(100 * k):
        broken = np.where(positive, weights < -small, gradient < -small)
        count = broken.sum(1)
        rows = np.flatnonzero(count)
        if not len(rows):
            break
        better = count[rows] < fewest[rows]
        fewest[rows[better]], tries[rows[better]] = count[rows[better]], 3
        alone = ~better & (tries[rows] == 0)
        tries[rows[~better & ~alone]] -= 1
        flip = broken[rows]
        last = k - 1 - np.argmax(flip[alone][:, ::-1], axis=1)
        flip[alone] = np.arange(k) == last[:, None]
        positive[rows] ^= flip
        sets, which = np.unique(positive[rows] @ (1 << np.arange(k)), return_inverse=True)
        on = (sets[:, None] >> np.arange(k) & 1).astype(bool)
        inverses = _inverses(sets, on, square, solved)
        weights[rows] = np.where(on[which], (inverses[which] @ cross[rows][:, :, None])[:, :, 0], 0)
        gradient[rows] = np.where(on[which], 0, weights[rows] @ square - cross[rows])
    return np.maximum(weights, 0)


def _inverses(sets: np.ndarray, on: np.ndarray, square: np.ndarray, solved: dict[int, np.ndarray] | None) -> np.ndarray:
    """The inverse of ``square`` within each set."""
    solved = {} if solved is None or len(solved) + len(sets) > 1 << 14 else solved
    new = np.array([s not in solved for s in sets.tolist()], dtype=bool)
    if new.any():
        fresh = np.linalg.pinv(np.where(on[new][:, :, None] & on[new][:, None, :], square, 0), hermitian=True)
        solved.update(zip(sets[new].tolist(), fresh))
    return np.stack([solved[s] for s in sets.tolist()])


def gradient_left(topics: np.ndarray, ww: np.ndarray, wx: np.ndarray) -> float:
    """Sum of the projected gradient of the topics; that of the weights is zero, as they are the best for these topics."""
    gradient = ww @ topics - wx
    return float(np.abs(np.where(topics > 0, gradient, np.minimum(gradient, 0))).sum())


_CELLS = "kind string, a int, b int, value double"


def _packed(rows: DataFrame) -> DataFrame:
    """One row per block, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in blocks(batch):
                parts = block.starts.astype(np.int32), block.ids.astype(np.int32), block.weights
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in parts], names=["starts", "ids", "weights"])

    return rows.select("term_ids", "weights").mapInArrow(pack, "starts binary, ids binary, weights binary")


def _sum_pass(packed: DataFrame, work: Callable[[Block, dict], None]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs ``work`` over all blocks; each task adds into matrices, Spark adds the tasks up.

    Every matrix has topics-by-terms cells at most, so the driver receives a bounded result: rows, columns and values by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for starts, ids, weights in zip(*batch.columns):
                work(Block(*(np.frombuffer(x.as_buffer(), t) for x, t in ((starts, np.int32), (ids, np.int32), (weights, np.float64)))), sums)
        for kind, matrix in sums.items():
            a, b = np.nonzero(matrix)
            columns = [pa.repeat(kind, len(a)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(matrix[a, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "value"])

    cells = packed.mapInArrow(run, _CELLS)
    table = cells.groupBy("kind", "a", "b").agg(F.sum("value").alias("value")).toArrow()
    out = {}
    for kind in table.column("kind").unique().to_pylist():
        mine = table.filter(pc.equal(table.column("kind"), kind))
        out[kind] = tuple(mine.column(c).to_numpy() for c in ("a", "b", "value"))
    return out


def _matrix(cells: tuple[np.ndarray, np.ndarray, np.ndarray] | None, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    if cells is not None:
        out[cells[0], cells[1]] = cells[2]
    return out


def _leading_terms(rows: DataFrame, width: int, k: int, seed: int, passes: int) -> np.ndarray:
    """Right singular vectors of the document-term matrix, by subspace iteration."""
    size = min(width, k + 8)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))
    for _ in range(passes):

        def work(block: Block, sums: dict, basis: np.ndarray = basis) -> None:
            part = sums.setdefault("y", np.zeros(basis.shape))
            part += block.transposed_times(block.times(basis), width)

        image = _matrix(_sum_pass(rows, work).get("y"), basis.shape)
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        right = basis @ vectors[:, np.argsort(values)[::-1][:k]]
        basis, _ = np.linalg.qr(image)
    return right


def _start(rows: DataFrame, width: int, k: int, seed: int, passes: int) -> np.ndarray:
    """Topic matrix from the larger signed part of each singular pair."""
    right = _leading_terms(rows, width, k, seed, passes)

    def work(block: Block, sums: dict) -> None:
        left = block.times(right)
        part = sums.setdefault("u", np.zeros((2, right.shape[1])))
        part[0] += (np.maximum(left, 0) ** 2).sum(0)
        part[1] += (np.minimum(left, 0) ** 2).sum(0)

    signs = np.sqrt(_matrix(_sum_pass(rows, work).get("u"), (2, right.shape[1])))
    topics = np.zeros((right.shape[1], width))
    for j in range(right.shape[1]):
        plus, minus = np.maximum(right[:, j], 0), np.maximum(-right[:, j], 0)
        sides = [(signs[0, j] * np.linalg.norm(plus), plus), (signs[1, j] * np.linalg.norm(minus), minus)]
        size, part = max(sides, key=lambda s: s[0])
        length = np.linalg.norm(part)
        if length > 0:
            # The norm of the unscaled left side already holds the singular value.
            topics[j] = np.sqrt(size) * part / length
    return topics


def factorise(
    rows: DataFrame, terms_: list[str], k: int = 8, max_iter: int = 400, tol: float = 1e-4, seed: int = 42, passes: int = 6
) -> Factors:
    """Non-negative topics of rows with ``term_ids`` and ``weights``.

    Ends after ``max_iter`` rounds, or once the sum of the projected gradient is ``tol`` times that of the first round. Blocks
    of rows are kept by Spark between rounds.
    """
    width = len(terms_)
    rows = _packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    topics = _start(rows, width, k, seed, passes)
    factors = Factors(terms_, topics)
    first = None
    for _ in range(max_iter):
        square = topics @ topics.T
        solved: dict[int, np.ndarray] = {}

        def work(block: Block, sums: dict, topics: np.ndarray = topics, square: np.ndarray = square, solved: dict = solved) -> None:
            cross = block.times(topics.T)
            own = exact_weights(cross, square, solved)
            ww = sums.setdefault("ww", np.zeros(square.shape))
            ww += own.T @ own
            wx = sums.setdefault("wx", np.zeros((width, topics.shape[0])))
            wx += block.transposed_times(own, width)
            fit = sums.setdefault("fit", np.zeros((1, 1)))
            fit += (block.weights**2).sum() - 2 * (own * cross).sum()

        sums = _sum_pass(rows, work)
        ww = _matrix(sums.get("ww"), square.shape)
        wx = _matrix(sums.get("wx"), (width, square.shape[0])).T
        error = _matrix(sums.get("fit"), (1, 1))[0, 0] + (ww * square).sum()
        factors.errors.append(float(error))
        left = gradient_left(topics, ww, wx)
        first = left if first is None else first
        if left <= tol * first:
            break
        topics = topics.copy()
        for _ in range(10):
            for j in range(len(topics)):
                if ww[j, j] > 0:
                    topics[j] = np.maximum(topics[j] + (wx[j] - ww[j] @ topics) / ww[j, j], 0)
        factors.topics = topics
    rows.unpersist()
    return factors


def with_term_ids(documents: DataFrame, vocab_terms: list[str], id_column: str) -> DataFrame:
    """Document rows with term numbers, written out once for the passes."""
    spark = documents.sparkSession
    ids = spark.createDataFrame([(t, i) for i, t in enumerate(vocab_terms)], "term string, term_id long")
    long = long_weights(documents, id_column).join(F.broadcast(ids), "term")
    rows = long.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_items"))
    return checkpointed(
        rows.select(id_column, F.col("_items.term_id").alias("term_ids"), F.col("_items.weight").alias("weights"))
    )


def assign_topics(rows: DataFrame, factors: Factors, id_column: str) -> DataFrame:
    """(document, topic, topic_weight); a document without any weight gets topic -1."""
    topics = factors.topics
    square = topics @ topics.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, block in blocks(batch):
                own = exact_weights(block.times(topics.T), square, solved)
                ends = _ends(np.full(len(own), own.shape[1]))
                columns = [batch.column(0).slice(part.start, len(own)), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "topic_weights"])

    schema = T.StructType().add(rows.schema[id_column]).add("topic_weights", T.ArrayType(T.DoubleType()))
    weighted = rows.select(id_column, "term_ids", "weights").mapInArrow(run, schema)
    largest = F.array_max("topic_weights")
    return weighted.select(
        id_column,
        F.when(largest > 0, longest_argument(F.col("topic_weights"))).otherwise(-1).alias("topic"),
        largest.alias("topic_weight"),
    )


def top_terms(spark: SparkSession, factors: Factors, n: int = 8) -> DataFrame:
    """(topic, top_words): the n heaviest terms of each topic, heaviest first."""
    lines = []
    for j, row in enumerate(factors.topics):
        order = sorted(range(len(row)), key=lambda i: (-row[i], factors.terms[i]))[:n]
        lines.append((j, ", ".join(factors.terms[i] for i in order)))
    return spark.createDataFrame(lines, "topic int, top_words string")


def topic_examples(assigned: DataFrame, documents: DataFrame, id_column: str, text: str, n: int = 2) -> DataFrame:
    """The n heaviest distinct texts per topic.

    Equal texts are found by digest; whole texts are only joined to the few rows kept.
    """
    digests = documents.select(id_column, F.md5(F.col(text).cast("binary")).alias("_digest"))
    best = (
        assigned.where("topic >= 0")
        .join(digests, id_column)
        .groupBy("topic", "_digest")
        .agg(F.min(F.struct((-F.col("topic_weight")).alias("minus"), F.col(id_column).alias("id"))).alias("_best"))
        .select("topic", (-F.col("_best.minus")).alias("topic_weight"), F.col("_best.id").alias(id_column))
    )
    window = Window.partitionBy("topic").orderBy(F.col("topic_weight").desc(), id_column)
    kept = best.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)
    return documents.select(id_column, text).join(F.broadcast(kept), id_column)
