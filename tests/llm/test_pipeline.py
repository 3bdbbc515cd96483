"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from fixtures import near_classes, no_documents, odd_documents, odd_rows, repeated_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """What each stage gets, and the last result."""
    held = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.written(stage(spark, held[-1], SF), "test"))
    return held


def test_all_but_the_last_keep_the_columns(inputs):
    assert all(df.columns == inputs[0].columns for df in inputs[:-1])


def test_low_quality_goes_and_good_stays(spark, inputs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in inputs[1].collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels)


def test_one_of_each_class_stays(inputs):
    rows = sorted((r.doc_id, r.text) for r in inputs[1].collect())
    classes = near_classes(rows)
    expected = {rows[i][0] for i in set(classes)}
    assert Counter(r.doc_id for r in inputs[2].collect()) == Counter(expected)


def test_repeats_go(inputs):
    rows = [(r.doc_id, r.text) for r in inputs[2].collect()]
    got = {r.doc_id: r for r in inputs[3].collect()}
    assert len(got) == len(rows)
    for (i, text), spans in zip(rows, repeated_spans([r[1] for r in rows]), strict=True):
        data, kept, at = text.encode(), b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        text = (kept + data[at:]).decode("utf-8", "ignore")
        assert got[i].text == text and got[i].n_chars == len(text)


def test_everything_left_is_packed(inputs):
    ids = {r.doc_id for r in inputs[3].collect()}
    rows = inputs[4].collect()
    assert {r.doc_id for r in rows} == ids
    room = Counter()
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def test_stages_stand_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        n = docs.count()
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.written(stage(spark, docs, SF), "test")
            if at < 3:
                assert out.columns == docs.columns
                assert out.count() <= n
            else:
                assert out.count() >= n
    second = corpus_pipeline.written(corpus_pipeline.one_of_each_group(spark, odd_documents(spark), SF), "test")
    assert second.count() == len(set(near_classes(odd_rows())))
