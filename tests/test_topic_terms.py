"""The vocabulary found before the bags are made, and the blocks that the passes of a fit run over."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motorspark.operators import topics
from motorspark.plans import recalls

STOP = ["the", "of"]
TEXTS = ["Fire in the engine engine", None, "", "fire risk fire risk", "engine stall on the road", "seat belt", "fire engine seat", "x y z",
         "engine fire of engine", "Key İn LOCK", "key lock-key lock", "the", "café seat belt seat belt"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS * 3)), "id long, t string").repartition(3)


def wanted_terms(docs, min_df, most, pairs=True):
    counts = topics.term_counts(docs, "id", "t", STOP, pairs)
    return topics.vocabulary(counts, topics.document_count(docs, "t"), min_df, most).collect()


def test_two_passes_find_the_vocabulary(docs, monkeypatch):
    monkeypatch.setattr(topics, "MAX_COUNTS", 4)
    blocks = topics.word_blocks(docs, "id", "t", STOP)
    for min_df, most, pairs in [(4, 6, True), (1, 200, True), (3, 9, True), (4, 6, False), (500, 5, True)]:
        wanted = [r["term"] for r in wanted_terms(docs, min_df, most, pairs)]
        assert sorted(topics.likely_terms(blocks, min_df, most, pairs) or []) == sorted(wanted)


def test_a_pair_as_frequent_as_its_words_is_found_and_many_equal_words_are_left_to_the_sketch(spark):
    """The second word of the pair comes after the last wanted word; all are equally frequent."""
    few = spark.createDataFrame([(i, "aa zz") for i in range(3)], "id long, t string")
    assert topics.likely_terms(topics.word_blocks(few, "id", "t", []), 1, 2) == ["aa", "aa zz"]
    many = spark.createDataFrame([(0, "aa zz bb cc dd ee ff")], "id long, t string")
    assert topics.likely_terms(topics.word_blocks(many, "id", "t", []), 1, 2) is None
    names, rows = recalls.topic_rows(many, "id", "t", [], 1, 2)
    assert names == ["aa", "aa zz"] and rows.count() == 1


def test_bags_of_the_topic_queries_hold_the_vocabulary_alone(docs, monkeypatch):
    kept = []
    monkeypatch.setattr(recalls, "checkpointed", lambda df: kept.append(df) or df)
    names, _ = recalls.topic_rows(docs, "id", "t", STOP, 4, 6)
    bags = next(df for df in kept if "tfs" in df.columns)
    assert {t for r in bags.collect() for t in r["terms"]} == set(names)
    assert bags.count() == len(TEXTS) * 3


@pytest.mark.parametrize("among", [None, ["engine", "engine fire", "key", "key lock", "seat belt", "belt seat", "nowhere", "the"]])
def test_bags_of_blocks_are_those_of_the_texts(docs, among):
    counts = topics.term_counts(docs, "id", "t", STOP)
    wanted = {(r["id"], r["term"], r["tf"]) for r in counts.collect() if among is None or r["term"] in among}
    for blocks in (None, topics.word_blocks(docs, "id", "t", STOP)):
        found = topics.bags(docs, "id", "t", STOP, among=among, blocks=blocks)
        assert {(r["id"], t, n) for r in found.collect() for t, n in zip(r["terms"], r["tfs"])} == wanted
        assert sorted(r["id"] for r in found.select("id").collect()) == list(range(len(TEXTS) * 3))


def test_documents_with_letters_are_counted_without_lower_case(spark):
    df = spark.createDataFrame([(t,) for t in ["A", "z9", "\u212a", "\u0130", "\u00e9 1", "", None]], "t string")
    assert df.agg(topics.document_count(df, "t").alias("n")).first()["n"] == 4
    assert df.where(F.lower("t").rlike("[a-z]")).count() == 4


def test_vocabulary_without_a_sketch_is_the_same(docs):
    bags = topics.bags(docs, "id", "t", STOP)
    wanted = topics.frequent_terms(bags, F.lit(30), 3, 7).collect()
    assert topics.frequent_terms(bags, F.lit(30), 3, 7, buckets=0).collect() == wanted


def test_passes_of_a_fit_run_over_packed_blocks(spark, monkeypatch):
    random = np.random.default_rng(5)
    full = random.random((40, 30)) * (random.random((40, 30)) < 0.3) + np.eye(40, 30) + np.eye(40, 30, -30)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for i, r in enumerate(full)]
    df = spark.createDataFrame(rows, "id long, term_ids array<long>, weights array<double>").repartition(2)
    monkeypatch.setattr(topics, "MAX_ENTRIES", 50)
    packed = topics._packed(df)
    assert [t for _, t in packed.dtypes] == ["binary"] * 3 and 5 < packed.count() < 40
    right = random.normal(size=(30, 4))

    def work(block, sums):
        part = sums.setdefault("y", np.zeros((30, 4)))
        part += block.transposed_times(block.times(right), 30)

    assert np.allclose(topics._matrix(topics._sum_pass(packed, work)["y"], (30, 4)), full.T @ (full @ right))


def test_dense_and_sparse_blocks_agree():
    random = np.random.default_rng(6)
    lists = [random.permutation(2000)[:n].astype(np.int64) for n in (1, 5, 700, 2)]
    for own, dense in ((lists, True), ([x[:5] for x in lists], False)):
        batch = pd.DataFrame({"term_ids": own, "weights": [random.random(len(x)) for x in own]})
        arrow = pa.RecordBatch.from_arrays([pa.array(batch["term_ids"]), pa.array(batch["weights"])], names=["term_ids", "weights"])
        full = np.zeros((4, 2000))
        for i, (x, w) in enumerate(zip(batch["term_ids"], batch["weights"])):
            full[i, x] = w
        right = random.normal(size=(2000, 3))
        for source in (batch, arrow):
            ((rows, block),) = topics.blocks(source)
            assert (block.dense(2000) is not None) is dense and rows == slice(0, 4)
            assert np.allclose(block.times(right), full @ right)
            assert np.allclose(block.transposed_times(right[:4], 2000), full.T @ right[:4])


def test_kept_inverses_give_the_same_weights():
    random = np.random.default_rng(7)
    matrix = np.abs(random.normal(size=(5, 20)))
    cross, solved = random.normal(size=(50, 20)) @ matrix.T, {}
    wanted = topics.exact_weights(cross, matrix @ matrix.T)
    for _ in range(2):
        assert (topics.exact_weights(cross, matrix @ matrix.T, solved) == wanted).all() and solved


def test_words_of_a_block_do_not_keep_the_batch_it_came_in():
    def cells():
        ends = np.array([0, 2, 1 << 23], dtype=np.int32)
        kinds = np.array([2], np.int32), np.array([1, 0], np.uint16), ends
        return [pa.array([[7]], pa.list_(pa.int64())), *(pa.array([k.tobytes()]) for k in kinds), pa.array([b"a" * (1 << 23)])]

    before = pa.total_allocated_bytes()
    found = list(topics._coded_blocks(iter([pa.RecordBatch.from_arrays(cells(), names=["ids", "sizes", "codes", "ends", "letters"])])))
    ((ids, known, rows, codes),) = found
    assert ids.to_pylist() == [7] and known[0].as_py() == "aa" and rows.tolist() == [0, 0] and codes.tolist() == [1, 0]
    assert pa.total_allocated_bytes() - before < 1 << 20


def test_numbers_of_few_words_take_two_bytes(docs):
    for r in topics.word_blocks(docs, "id", "t", STOP).collect():
        assert len(r["codes"]) == 2 * int(np.frombuffer(r["sizes"], np.int32).sum())
