"""Operators on texts against plain versions, on odd and on empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import PROSE, SCHEMA, near_classes, no_documents, odd_documents, odd_rows, repeated_spans, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorspark.llm import chunks, licenses, near_duplicates, packing, pieces, quality, repeats, token_files
from motorspark.llm.common import ship

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(ship(spark))


def library(path: str, texts: list[str | None]) -> list[list[int]]:
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return [e.ids for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "spaces"), [(WORD, False), (BYTE, True)])
def test_chunks_give_the_library_ids(path, spaces):
    random.seed(5)
    texts = [r[1] or "" for r in odd_rows()] + ["".join(random.choice(" \n\tab'sé.,1²ßΣΑİ") for _ in range(40)) for _ in range(400)]
    coder = chunks.ChunkEncoder(path, spaces, limit=100)
    for part in (texts[:200], texts[200:], texts):
        flat, counts = coder.encode(part)
        expected = library(path, part)
        assert counts.tolist() == [len(e) for e in expected]
        assert flat.tolist() == [i for e in expected for i in e]


def test_code_lengths_are_a_full_code_within_the_limit():
    random.seed(3)
    for n in (1, 2, 3, 10, 300):
        places = np.array([int(1.5 ** random.randint(0, 40)) + 1 for _ in range(n)])
        bits = token_files.code_lengths(places, 9)
        assert bits.max() <= 9
        assert n == 1 or sum(2.0**-bits) == 1
    assert token_files.code_lengths(np.array([1, 1, 2, 3, 5, 8]), 20).tolist() == [5, 5, 4, 3, 2, 1]


def test_token_files_round_trip(spark, docs):
    rows = token_files.through_files(docs, WORD, 1, False).collect()
    source = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = [(r.id, r.n, bytes(r.ids)) for r in sorted(rows, key=lambda r: r.start)]
    expected = [(r[0], len(i) + 1, np.array([*i, 1], "<u4").tobytes()) for r, i in zip(source, library(WORD, [r[1] for r in source]), strict=True)]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert Counter(got) == Counter(expected)
    starts = sorted(r.start for r in rows)
    assert starts == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()]
    assert token_files.through_files(no_documents(spark), WORD, 1, False).count() == 0


def test_packing_places_every_piece(spark, docs):
    rows = packing.packed_documents(docs, BYTE, 2, 64).collect()
    expected = Counter()
    for r, ids in zip(odd_rows(), library(BYTE, [r[1] for r in odd_rows()]), strict=True):
        at = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids) + 1, 64)):
            expected[r[0], piece, at, n, np.array([*ids, 2][at : at + n], "<u4").tobytes()] += 1
            at += n
    assert Counter((r.id, r.piece, r.start, r.n, bytes(r.ids)) for r in rows) == expected
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.n
    assert max(ends.values()) <= 64
    assert packing.packed_documents(no_documents(spark), BYTE, 2, 64).count() == 0


def fewest(items: list[int], size: int) -> int:
    best = len(items)

    def place(at: int, bins: tuple[int, ...]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b + items[at] <= size}:
            i = bins.index(room)
            place(at + 1, tuple(sorted((*bins[:i], room + items[at], *bins[i + 1 :]))))
        place(at + 1, tuple(sorted((*bins, items[at]))))

    place(0, ())
    return best


def test_bin_completion_finds_the_fewest_bins():
    random.seed(8)
    for _ in range(60):
        items = sorted((random.randint(1, 30) for _ in range(random.randint(1, 11))), reverse=True)
        counts = np.bincount(items, minlength=31)
        plan = packing.bin_completion(counts, 30)
        assert Counter(a for p, c in plan for a in p for _ in range(c)) == Counter(items)
        assert sum(c for _, c in plan) == fewest(items, 30)
        assert packing.lower_bound(counts, 30) <= fewest(items, 30)


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = odd_rows()
    got = near_duplicates.near_duplicates(docs).collect()
    classes = near_classes(rows)
    smallest: dict[int, int] = {}
    for r, c in zip(rows, classes, strict=True):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    assert Counter((r.id, r.class_id) for r in got) == Counter((r[0], smallest.get(c)) for r, c in zip(rows, classes, strict=True))
    assert sum(r.first for r in got) == len(set(classes))
    assert near_duplicates.near_duplicates(no_documents(spark)).count() == 0


def test_chains_of_near_duplicates_are_one_class(spark):
    random.seed(2)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):  # each is close to the next one only
        base = base[3:] + [f"w{random.randint(0, 10**6)}" for _ in range(3)]
        rows.append((i, " ".join(base), "en", "s", 1))
    rows += [(100 + i, " ".join(f"v{random.randint(0, 10**6)}" for _ in range(50)), "en", "s", 1) for i in range(30)]
    got = {r.id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(60)} == {0}
    assert all(got[100 + i] == 100 + i for i in range(30))


def test_large_buckets_are_split_and_still_whole(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    random.seed(4)
    rows, line = [], " ".join(f"c{i}" for i in range(30))
    for i in range(40):  # pairs of near copies that share a long line with all others
        own = " ".join(f"u{i // 2}x{j}" for j in range(25))
        rows.append((i, f"{line} {own}" + (" end" if i % 2 else ""), "en", "s", 1))
    got = {r.id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: near_classes(rows)[i] for i in range(40)}


def test_probability_jaccard_with_weights():
    a, b = Counter("aaabbc"), Counter("abbbdd")
    from fixtures import probability_jaccard

    cells = [(np.array(sorted(map(ord, x)), np.uint64), np.array([x[k] for k in sorted(x)], np.int32)) for x in (a, b)]
    assert near_duplicates.probability_jaccard(*cells[0], *cells[1]) == pytest.approx(probability_jaccard(a, b))


def check_repeats(spark, df, rows):
    got = Counter((r.row.doc_id, r.n_bytes, tuple((s["from"], s["to"]) for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.without_repeats(df).collect())
    expected = Counter()
    for r, spans in zip(rows, repeated_spans([r[1] for r in rows]), strict=True):
        data = (r[1] or "").encode()
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        expected[r[0], len(data), tuple(spans), hashlib.sha256(kept + data[at:]).hexdigest()] += 1
    assert got == expected


def test_repeats_against_all_windows(spark, docs):
    check_repeats(spark, docs, odd_rows())
    assert repeats.without_repeats(no_documents(spark)).count() == 0
    assert repeats.without_repeats(docs, as_text=True, keep=tuple(docs.columns)).schema["kept"].dataType.simpleString() == "string"


@pytest.mark.parametrize(("segment", "collection"), [(1 << 21, 1 << 14), (500, 3)])
def test_repeats_of_random_passages(spark, monkeypatch, segment, collection):
    """Also in small segments, and with buckets that are split over collections."""
    if collection < 100:
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        monkeypatch.setattr(repeats, "COLLECTION", collection)
    random.seed(6)
    passages = ["".join(random.choice("ab") for _ in range(random.randint(150, 420))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = ["".join(random.choice("abcdé \n") for _ in range(random.randint(0, 300))) for _ in range(3)]
        rows.append((i, parts[0] + random.choice(passages) + parts[1] + random.choice(passages)[random.randint(0, 40) :] + parts[2], "en", "s", 1))
    check_repeats(spark, spark.createDataFrame(rows, SCHEMA), rows)


def test_license_scan_against_all_places(spark, docs):
    got = Counter((r.doc_id, r.n_words, tuple(r.places), tuple(r.labels_of_phrases)) for r in licenses.license_scan(docs).collect())
    expected = Counter()
    for r in odd_rows():
        own, places, labels = words(r[1]), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(own)) if own[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        expected[r[0], len(own), tuple(sorted(places)), tuple(sorted(labels))] += 1
    assert got == expected
    assert licenses.license_scan(no_documents(spark)).count() == 0


def test_license_notices_with_words_put_in(spark):
    notice = licenses.NOTICES[4][0].split()
    changed = " ".join([*notice[:6], "really", *notice[6:]])
    rows = [(1, changed, "en", "s", 1), (2, " ".join(notice[:8]), "en", "s", 1), (3, PROSE, "en", "s", 1)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].labels == ["mit-text"] and got[1].score >= 0.9
    assert got[1].spans[0]["first"] == 0 and got[1].spans[0]["last"] == len(notice)
    assert got[2].labels == [] and 0 < got[2].score < 0.75
    assert got[3].score < 0.2


def test_quality_on_odd_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(14, 0, 0), (13, 0, 0), (None, 1, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = quality.quality_scores(docs, known).collect()
        assert len(rows) == len(odd_rows())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    by_id = Counter((r.doc_id, r.score) for r in rows)
    assert by_id[3, next(r.score for r in rows if r.doc_id == 3)] == 2
    assert quality.quality_scores(no_documents(spark), labels).count() == 0


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def test_gradients_of_the_attention_model():
    random = np.random.default_rng(1)
    bags = [random.normal(size=(k, quality.FEATURES)).astype(np.float32) for k in (1, 4, 2)]
    y, text = np.array([0.0, 1.0, 1.0]), np.repeat([0, 1, 2], [1, 4, 2])
    model = quality.fit(bags, y, steps=2)
    x = np.concatenate(bags)
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, text, 3)["p"]) + (1 - y) * np.log(1 - p))
    found = model.gradients(text, y, model.forward(x, text, 3))
    for name, at in (("E", (3, 2)), ("V", (1, 1)), ("U", (2, 3)), ("a", (4,)), ("c", (5,)), ("e", (0,))):
        model.weights[name][at] += 1e-5
        high = loss()
        model.weights[name][at] -= 2e-5
        low = loss()
        model.weights[name][at] += 1e-5
        assert found[name][at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)


def test_pieces_round_trip(spark, docs):
    rows = pieces.decoded(pieces.encoded(docs, PIECE), PIECE).collect()
    assert Counter((r.id, r.text) for r in rows) == Counter((r[0], r[1] or "") for r in odd_rows())
    assert all(len(r.ids) == 4 * r.n for r in rows)
    assert pieces.encoded(no_documents(spark), PIECE).count() == 0


def test_pieces_against_a_plain_search():
    own = pieces.Pieces(PIECE)
    score = {own.names[i]: own.scores[i] for i, k in enumerate(own.kinds) if k == pieces.NORMAL}
    random.seed(9)
    letters = "abehinorst.é☃  "
    texts = ["".join(random.choice(letters) for _ in range(random.randint(1, 30))) for _ in range(200)] + [PROSE]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        best = [0.0] + [-np.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - own.longest), end):
                value = score.get(marked[start:end], own.floor if end - start == 1 else -np.inf)
                best[end] = max(best[end], best[start] + value)
        total, run = 0.0, b""
        for i in np.frombuffer(ids, np.uint32).tolist():
            if own.kinds[i] == pieces.BYTE:
                run += bytes([own.byte_at[i]])
                try:
                    run.decode()
                except UnicodeDecodeError:
                    continue
                total, run = total + own.floor, b""
            else:
                total += own.scores[i]
        assert total == pytest.approx(best[-1])
        assert own.decode(ids) == text


def test_held_out_is_the_checksum_rule(spark):
    ids = spark.range(200).withColumn("h", quality.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)
