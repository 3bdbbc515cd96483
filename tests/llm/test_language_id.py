"""Language identification against a plain version and on rows it has not learned from."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter

import pytest
from fixtures import SCHEMA, odd_documents, odd_rows
from pyspark.sql import functions as F

from motorspark.llm import language_id, queries
from motorspark.llm.common import ship
from motorspark.llm.quality import held_out


def plain_words(text: str | None) -> list[str]:
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            run += c
        elif run:
            out += [run[i : i + language_id.MOST] for i in range(0, len(run), language_id.MOST)]
            run = ""
    return out


def plain_grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def plain(rows: list[tuple], learned) -> list[tuple]:
    lengths = range(1, language_id.LONGEST + 1)
    train = [(lang, plain_words(text)) for i, text, lang, *_ in rows if learned(i) and lang is not None]
    langs = sorted({x for x, _ in train}, key=lambda x: (-sum(y == x for y, _ in train), x))
    words = {g: Counter(w for x, ws in train if x == g for w in ws) for g in langs}
    grams = {g: {n: Counter(p for w, c in words[g].items() for p in plain_grams(w, n) for _ in range(c)) for n in lengths} for g in langs}
    sums = {g: [sum(words[g].values()), *(sum(grams[g][n].values()) for n in lengths)] for g in langs}

    def cost(count, g, kind):
        return math.log10(max(1, sums[g][kind])) - math.log10(count) if count else 1 + max(math.log10(max(1, sums[x][kind])) for x in langs)

    def value(word, g):
        if any(words[x][word] for x in langs):
            return cost(words[g][word], g, 0)
        for n in reversed(lengths):
            known = [p for p in plain_grams(word, n) if any(grams[x][n][p] for x in langs)]
            if known:
                return sum(cost(grams[g][n][p], g, n) for p in known) / len(known)
        return cost(0, g, 0)

    out = []
    for i, text, *_ in rows:
        if not langs or not any(c.isalpha() for c in (text or "").lower()):
            out.append((i, "und", 0.0))
            continue
        ws = Counter(plain_words(text))
        means = [sum(n * value(w, g) for w, n in ws.items()) / sum(ws.values()) for g in langs]
        best = min(range(len(langs)), key=lambda x: (round(means[x], 9), x))
        out.append((i, langs[best], 1 / sum(10 ** (min(means) - m) for m in means)))
    return out


def rows_of_languages() -> list[tuple]:
    rng = random.Random(4)
    syllables = {"aa": "th er on an re ing the and", "bb": "ein sch ich und der ung ß ü", "cc": "ção que os as ñ é"}
    rows = list(odd_rows())
    for i in range(120):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc"])
        text = " ".join("".join(rng.choices(syllables[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(1, 25)))
        rows.append((1000 + i, text, None if i % 11 == 0 else lang, "s", 1))
    return [*rows, (2000, "日本語 Ωmega ÅNGSTRÖM İstanbul ΣΑΣ", "dd", "s", 1), (2001, "ع ﷺ 日本", None, "s", 1), (2002, "́̂", "aa", "s", 1), (2003, "12 34", "aa", "s", 1)]


@pytest.mark.parametrize("block_bytes", [language_id.BLOCK, 300])
def test_against_a_plain_version(spark, block_bytes):
    rows = rows_of_languages()
    docs = ship(spark).createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).repartition(3)
    got = language_id.identified(docs, ~held_out(F.col("doc_id")), block_bytes=block_bytes)
    unseen = {i for (i,) in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    wanted = plain(rows, lambda i: i not in unseen)
    order = lambda line: (line[0] is None, line[0] or 0, line[1], line[2])
    found, wanted = sorted(((r.row.doc_id, r.lang_pred, r.score) for r in got.collect()), key=order), sorted(wanted, key=order)
    assert [line[:2] for line in found] == [line[:2] for line in wanted]
    assert [line[2] for line in found] == pytest.approx([line[2] for line in wanted], abs=1e-9)
    assert {x for i, x, _ in wanted if i in unseen} >= {"aa", "bb", "cc"}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 5000)
    text = "ab " * 3000 + "x" * 12345 + " cd" * 3000 + "é" * 7000
    parts = list(language_id.pieces(text))
    assert "".join(parts) == text and max(map(len, parts)) <= 5000
    found = [w for p in parts for w in plain_words(p)]
    assert Counter(found) == Counter(plain_words(text))


def test_a_long_text_and_long_runs(spark):
    text = "alpha beta " * 200_000 + "z" * 1_500_000
    rows = [(1, text, "aa", "s", 1), (4, "alpha", None, "s", 1), (5, "gamma delta", "bb", "s", 1), (6, "z" * 1000, None, "s", 1)]
    got = language_id.identified(ship(spark).createDataFrame(rows, SCHEMA), F.lit(True)).collect()
    assert {r.row.doc_id: r.lang_pred for r in got} == {1: "aa", 4: "aa", 5: "bb", 6: "aa"}


def test_nothing_learned_and_nothing_given(spark):
    docs = odd_documents(spark)
    assert {(r.lang_pred, r.score) for r in language_id.identified(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert language_id.identified(docs.limit(0), F.lit(True)).count() == 0
    assert language_id.identified(docs, F.lit(True)).count() == docs.count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_language_id(spark, sf)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share")).first().share
    assert got.count() == docs.count() and right >= 0.98
