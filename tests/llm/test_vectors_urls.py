"""Searches and url rules against plain versions, on odd and on empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import differences, duck
from fixtures import with_clashes
from pyspark.sql import functions as F

from motorspark.llm import permutation_index, queries, top_k, url_filters
from motorspark.llm.common import ship

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n: int = 90) -> list[tuple]:
    random.seed(7)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(6)], 1) for i in range(n)]
    rows += [(200 + i, rows[20][1], 1) for i in range(30)] + [(7, rows[7][1], 1), (20, rows[40][1], 2)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [math.nan] * 6, 1), (303, [math.inf, 1.0], 1), (304, [], 1), (305, [0.0] * 6, 1), (306, [0.5, 0.25], 1), (None, [1.0] * 6, 1), (320, [3.0] * 6, None)]
    return rows


def usable(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_against_all_products(spark):
    rows = odd_vectors()
    df = with_clashes(ship(spark).createDataFrame(rows, VECTORS)).repartition(3)
    got = top_k.exact_top_k(df, F.col("id") % 20 == 0, k=5, query_rows=3, block_rows=8, run_rows=20, head=2).collect()
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    expected = Counter()
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-dot(v, w), c) for c, w in whole if c != q)[:5]
            expected.update((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expected
    assert top_k.exact_top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert [r.rank for r in top_k.exact_top_k(few, F.col("id") == 0).collect()] == [1, 2]


def test_top_k_of_huge_numbers(spark):
    random.seed(11)
    # products below 2^53, beyond it, beyond a long, beyond a double
    sizes = [1.0, 1e6, 1e9, 1e30, 1e160, 1e300]
    rows = [(i, [random.choice([-1, 1]) * random.random() * sizes[i % 6] for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, [1e9 + i % 2, 2e9, 0.0, 0.0, 0.0]) for i in range(20)] + [(400, [1.7e308] * 5), (401, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = top_k.exact_top_k(df, F.col("id") % 20 == 0, k=7, query_rows=3, block_rows=8, run_rows=40, head=2).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if all(math.isfinite(64 * x) for x in v)]
    expected = Counter()
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q)[:7]
            expected.update((q, rank, c, -s if -(2**63) <= -s < 2**63 else None) for rank, (s, c) in enumerate(best, 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expected


def test_permutation_index_finds_what_there_is(spark):
    rows = odd_vectors()
    df = with_clashes(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = permutation_index.nearest(df, F.col("id") % 20 == 0, k=5, shard_rows=25, query_rows=3).collect()
    known = [(i, np.array([*np.float32(v), *[0] * (6 - len(v))], float)) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    cosine = lambda a, b: float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))
    # shards are smaller than the rows that get the exact measure, so the answer is exact here
    by_query: dict[int, list] = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    for q, v in known:
        if q % 20 == 0 and sum(1 for i, _ in known if i == q) == 1:
            best = sorted((-round(cosine(v, w), 12), c) for c, w in known if c != q)[:5]
            own = sorted(by_query[q], key=lambda r: r.rank)
            assert [(r.vec_id) for r in own] == [c for _, c in best]
            assert [r.score for r in own] == pytest.approx([-s for s, _ in best], abs=1e-9)
    assert sum(len(x) for x in by_query.values()) == 5 * sum(1 for i, _ in known if i % 20 == 0)
    assert permutation_index.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def recall(found: list, ids: np.ndarray, x: np.ndarray, part: np.ndarray, every: int) -> float:
    """Share of the five truly nearest that were found, for the queries among the rows of ``part``."""
    hits = wanted = 0
    x = x / np.sqrt((x**2).sum(1))[:, None]
    for at in np.flatnonzero(part & (ids % every == 0)):
        s = x @ x[at]
        s[at] = -2
        true = set(ids[np.argsort(-s)[:5]].tolist())
        hits += len(true & {r.vec_id for r in found if r.query_id == ids[at]})
        wanted += 5
    return hits / wanted


@pytest.mark.parametrize("hot", [0, 0.3, 1.0])
def test_permutation_index_recall(spark, hot):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    cluster = np.arange(len(ids)) % 3 == 0
    if hot:  # a third of all rows around one vector
        x[cluster] = 3 * np.sqrt((x[cluster] ** 2).sum(1))[:, None] * x[1] / np.sqrt((x[1] ** 2).sum()) + hot * x[cluster]
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got = permutation_index.nearest(table, F.col("id") % 50 == 0, k=5, least=64).collect()
    whole, outside = recall(got, ids, x, np.full(len(ids), True), 50), recall(got, ids, x, ~cluster, 50)
    print(f"hot {hot}: recall {whole:.3f}, outside the cluster {outside:.3f}")
    assert whole >= 0.95
    assert outside >= 0.93


def test_permutation_index_of_huge_numbers(spark):
    rows = [(i, [math.cos(i / 7) * 10.0 ** (i % 300), math.sin(i / 7) * 10.0 ** (i % 300)]) for i in range(60)]
    rows += [(100 + i, [x * 1e-200 for x in rows[i][1]]) for i in range(3)]
    got = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 5, k=3).collect()
    expected = sorted((-math.cos((5 - i % 100) / 7), i) for i, _ in rows if i != 5)[:3]
    assert [r.score for r in got] == pytest.approx([-s for s, _ in expected], abs=1e-12)


def test_url_verdicts_against_every_rule(spark):
    random.seed(1)
    hosts = ["net", "a.net", "b.a.net", "xnet", "example.com", "www.example.com", "Example.COM", "org", "x.org", "", ".", "a..net", "net.", "é.net"]
    paths = ["", "/", "/a", "/a/b", "/A", "/a?x=/b", "#/a", "?q", "/é"]
    urls = [None, "", "no host", "http:/x", "://net/a", "http://net/://org/"] + [f"{s}://{h}{p}" for s in ("http", "HTTPS", "x://y") for h in hosts for p in paths]
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls)] + [(1, urls[20])] * 50
    rules = [("net", "/", "block"), ("a.net", "/a", "allow"), ("a.net", "/a/", "block"), ("com", "", "block"), ("EXAMPLE.com", "/a/b", "allow"), ("org", None, "block"),
             ("a.net", "/a", "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/a/", None)]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string")).repartition(3)
    got = url_filters.url_verdicts(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    expected = Counter()
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    known: dict[tuple[str, str], str] = {}
    for h, p, v in rules:
        if h and v:
            known[lower(h), p or ""] = max(v, known.get((lower(h), p or ""), ""))
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        expected[i, host, path, best[1], best[2]] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filters.url_verdicts(df, none).collect()} == {"allow"}
    assert url_filters.url_verdicts(df.limit(0), none).count() == 0


def test_url_filters_run_no_python(spark):
    plan = queries.op2_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), duck(sf), queries.SQL[name]) == []
