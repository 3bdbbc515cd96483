
from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from fixtures import SCHEMA
from test_texts import BYTE, WORD, check_repeats
from tokenizers import Tokenizer

from motorspark.llm import chunks, near_duplicates, queries, repeats


def test_copies_of_a_text_are_cut_once_and_held_once(spark):
    text, key = "x" * 100 + "y" * 300, b"k" * 16
    one = {"text": text, "key": key, "copies": 300, "wanted": [{"h": 1, "f": 5, "p": 180, "salts": 1}]}
    given = pa.RecordBatch.from_pylist([one] * 100)
    cells = list(repeats.cut_fragments(iter([given] * 3)))
    assert sum(c.num_rows for c in cells) == 1
    # the same cell from very many tasks
    cell = {"h": 1, "salt": 0, "f": 5, "salts": 1, "cell": b"z" * 368, "gap": 0}
    other = cell | {"f": 6, "cell": b"z" * 300 + b"w" * 68}
    tracemalloc.start()
    found = list(repeats.compare(pa.RecordBatch.from_pylist([cell] * 500) if i < 100 else pa.RecordBatch.from_pylist([other]) for i in range(101)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(f.num_rows for f in found) == 2
    assert peak < 10_000_000


def test_repeats_with_very_many_copies(spark):
    random.seed(12)
    line = "".join(random.choice("abcdefgh ") for _ in range(700))
    rows = [(i, line, "en", "s", 1) for i in range(60)]
    rows += [(100 + i, f"{i} " * 90 + line[:450] + f" {i}" * 90, "en", "s", 1) for i in range(20)]
    check_repeats(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), rows)


def test_pairs_of_a_large_bucket_without_a_second_band_meet(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 60_000, (30, near_duplicates.REGISTERS)).astype(np.uint16)
    bands = [[int(b) for b in rng.integers(0, 1 << 60, near_duplicates.BANDS)] for _ in range(30)]
    scanned = spark.createDataFrame([(i, bytearray(signs[i].tobytes()), bands[i]) for i in range(30)], "row long, signature binary, bands array<long>")
    members = spark.createDataFrame([(9, 0, i, 30, 0) for i in range(30)], "bucket long, band int, row long, size long, leader long")
    roots = spark.createDataFrame([(i, 0) for i in range(12)], "node long, root long")
    dealt = near_duplicates.open_members(members, roots, scanned, narrowed=False)
    met, largest = set(), 0
    for task in dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct("row", "root", "left", "alone")).alias("m")).collect():
        largest = max(largest, len(task.m))
        pairs = [(min(a.row, b.row), max(a.row, b.row)) for a in task.m for b in task.m if a.left and a.root != b.root and (a.alone or not b.left)]
        assert not met & set(pairs)
        met |= set(pairs)
    assert met == {(a, b) for b in range(30) for a in range(b) if b >= 12}
    assert largest < 30


SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>", "x<|endoftext|>y.\nz <|ENDOFTEXT|> <|endoftext", "plain words only", "", " <|startoftext|> "]


def test_special_tokens_in_texts_are_the_librarys(spark):
    for path, spaces in ((WORD, False), (BYTE, True)):
        plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(SPECIAL, add_special_tokens=False)]
        flat, counts = chunks.ChunkEncoder(path, spaces, specials=True).encode(SPECIAL)
        assert counts.tolist() == [len(p) for p in plain]
        assert flat.tolist() == [i for p in plain for i in p]


def test_queries_give_special_tokens_as_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(SPECIAL)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for query, path, end in ((queries.op4_token_files, WORD, 1), (queries.op9_best_fit_packing, BYTE, 2)):
        expected = {i: crc([*e.ids, end]) for i, e in enumerate(Tokenizer.from_file(path).encode_batch(SPECIAL, add_special_tokens=False))}
        assert {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()} == expected
