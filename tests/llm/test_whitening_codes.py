"""Whitening and vector codes against plain versions, on odd, small and empty tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from fixtures import with_clashes
from pyspark.sql import functions as F
from test_vectors_urls import VECTORS, odd_vectors, usable

from motorspark.llm import codebooks, queries, whitening
from motorspark.llm.common import ship
from motorspark.llm.exact import integers


def whole(rows, scale, shift=0, dims=6):
    """(id, label, numbers) of the usable rows, padded with zeros."""
    out = []
    for i, v, label in rows:
        if usable(v):
            x = [float(np.float32(c)) for c in v] + [0.0] * (dims - len(v))
            out.append((i, label, [math.floor(Fraction(c) * scale) + shift for c in x]))
    return out


def plain_polynomial(a: list[list[int]]) -> list[int]:
    """Coefficients of det(x - a), the constant one first, by powers and traces."""
    d = len(a)
    m, out = [[0] * d for _ in range(d)], [0] * d + [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (out[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        out[d - k] = -sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) // k
    return out


def test_polynomial_and_roots(spark):
    ship(spark)
    random = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (7, 3), (12, 12)):
        x = random.integers(-50, 50, (rank + 2 if rank == d else rank, d))
        a = [[int(c) for c in line] for line in x.T @ x * 10**12]
        found = whitening.characteristic_polynomial(spark, a)
        assert found == plain_polynomial(a)
        wanted = np.sort(np.linalg.eigvalsh(np.array(a, float)))[::-1]
        for k in range(1, min(rank, d) + 1):
            root, above, size = whitening.isolated(found, k)
            assert (above, size) == (k - 1, 1) and float(root) == pytest.approx(wanted[k - 1], rel=1e-9)
    assert not whitening.is_prime(2**31 + 1) and whitening.is_prime(2**31 - 1) and not whitening.is_prime(25326001)


def check_whitening(spark, df, rows, dims, components=32):
    x = whole(rows, 64, 1_000_000, dims)
    n = len(x)
    sums = [sum(v[j] for _, _, v in x) for j in range(dims)]
    model = whitening.fit(df, 64, components)
    got = whitening.whitened(df, model, keep=("vec_id", "label")).collect()
    assert model.n == n and Counter((r.row.vec_id, int(r.deviation)) for r in got) == Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, _, v in x)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for _, _, v in x])
    cov = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert model.eigenvalues == pytest.approx(values[: len(model.eigenvalues)], rel=1e-9)
    assert model.explained == pytest.approx(model.eigenvalues / np.trace(cov), rel=1e-12)
    assert np.abs(cov @ model.components.T - model.components.T * model.eigenvalues).max() <= 1e-12 * values[0]
    assert np.abs(model.components @ model.components.T - np.eye(len(model.components))).max() < 1e-12
    projected = centred @ model.components.T / np.sqrt(model.eigenvalues)
    assert Counter((i, *np.round(p, 6) + 0.0) for (i, _, _), p in zip(x, projected, strict=True)) == Counter((r.row.vec_id, *(np.round(r.whitened, 6) + 0.0)) for r in got)
    assert whitening.identity_error(df, model) < 1e-9
    return model


def test_whitening_against_a_plain_version(spark):
    rows = odd_vectors()
    df = with_clashes(ship(spark).createDataFrame(rows, VECTORS)).repartition(3)
    assert len(check_whitening(spark, df, rows, 6).components) == 6
    assert len(check_whitening(spark, df, rows, 6, 2).components) == 2


def test_whitening_with_equal_and_missing_directions(spark):
    # four equal eigenvalues, one larger, one of zero, and one entry far beyond the others
    rows = [(10 * i + s, [float((1 + (i == 0)) * (2 * s - 1) * (i == j)) for j in range(5)] + [0.5], 1) for i in range(5) for s in (0, 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    model = check_whitening(spark, df, rows, 6)
    assert len(model.components) == 5 and len(set(np.round(model.eigenvalues, 9))) == 2
    far = [*rows, (99, [3e7, -2e7, 0.0, 0.0, 0.0, 0.0], 1)]
    wide = spark.createDataFrame(far, VECTORS)
    x = whole(far, 64)
    model = whitening.fit(wide)
    got = {r.row.vec_id: int(r.deviation) for r in whitening.whitened(wide, model, ("vec_id",)).collect()}
    sums = [sum(v[j] for _, _, v in x) for j in range(6)]
    assert got == {i: sum((len(x) * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, _, v in x}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1)], [(1, [], 1)], [(1, [1.0], 1), (2, [1.0], 1), (3, None, 1)]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    assert whitening.fit(df) is None and whitening.whitened(df, None, ("vec_id",)).count() == 0


def plain_codes(rows, parts, entries, rounds, scale, dims):
    size = -(-dims // parts)
    kept = whole(rows, scale, 0, parts * size)
    raw = {n: [float(np.float32(c)) for c in v] for n, v in enumerate(v for _, v, _ in rows if usable(v))}
    cut = [[v[p * size : p * size + size] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, raw[n]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), at) for at, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            who = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, w in zip(cut, who, strict=True) if w == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(column) // len(mine) for column in zip(*mine, strict=True)], *books[p][e + 1 :]]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    lines = [(k[0], k[1], "".join(f"{f[1]:02x}" for f in near), sum(f[0] for f in near)) for k, near in zip(kept, found, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    by_label = Counter()
    for _, label, _, error in lines:
        by_label[label] += error
    return Counter((i, label, code, error, by_label[label], digest) for i, label, code, error in lines)


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("parts,entries", [(2, 4), (4, 16), (8, 3)])
def test_codes_against_a_plain_version(spark, far, parts, entries):
    rows = odd_vectors(60) + ([(500, [1e8, -1e8, 3e9, 0.0, 0.0, 1.0], 1)] if far else [])
    df = with_clashes(ship(spark).createDataFrame(rows, VECTORS)).repartition(3)
    found = codebooks.compressed(df, ("vec_id", "label"), parts, entries, 3, 4096)
    lines = codebooks.with_label_error(found.rows).select("row.vec_id", "row.label", codebooks.hex_code("codes").alias("code"), "error", "label_error")
    got = Counter((r.vec_id, r.label, r.code, int(r.error), int(r.label_error), found.digest) for r in lines.collect())
    assert got == plain_codes(rows, parts, entries, 3, 4096, 6)


def test_search_looks_at_all_entries_of_equal_distance():
    random = np.random.default_rng(2)
    for kind in (np.int64, object):
        book = random.integers(-4, 5, (9, 3)).astype(kind)
        x = random.integers(-6, 7, (400, 3)).astype(kind)
        code, best = codebooks.nearest_entries(x, book)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        assert code.tolist() == far.astype(int).argmin(1).tolist() and best.tolist() == far.min(1).tolist()


def test_codes_of_nothing_and_of_few(spark):
    none = codebooks.compressed(spark.createDataFrame([], VECTORS), ("vec_id", "label"))
    assert codebooks.with_label_error(none.rows).count() == 0 and none.digest == hashlib.sha256(b"").hexdigest()
    few = codebooks.compressed(spark.createDataFrame([(None, [1.0, 2.0], None), (4, [], None)], VECTORS), ("vec_id", "label"))
    assert sorted(tuple(r.codes) for r in few.rows.collect()) == [(0,) * 8, (1, 1, *(0,) * 6)]


def test_whole_numbers_round_down():
    assert integers(np.array([[-0.01, 0.01, -1.0]]), 64).tolist() == [[-1, 0, -64]]
    assert integers(np.array([[1e300, -0.01]]), 2).tolist() == [[int(1e300) * 2, -1]]


def test_query_columns(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    first = got.agg(F.count("*").alias("rows"), F.max("component").alias("most"), F.max("identity_error").alias("error")).first()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert first.most == 32 and first.rows == 32 * n and first.error < 1e-4
