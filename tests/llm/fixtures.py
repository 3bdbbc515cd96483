"""Small tables with every oddity the operators must stand, and plain versions of what they compute."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The and attion to thanedble the anea eriner thanea anre onerin whtire onhaan inesble onshonnt eranhe thstonly thed eaor thoutiat therhe oressh was ofonouinre erealy nd and"


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def odd_rows() -> list[tuple]:
    shared = "one passage that stands in several texts of this table, " * 5
    texts = [
        None, "", " ", "\n\n", "a", "?!", PROSE, PROSE, PROSE.upper(), PROSE + " more", shared + "alpha beta", "gamma delta " + shared, "é" * 150 + shared,
        "de " * 400, "x" * 1000, "Ünï cödé ☃ 日本語 \U0001f600 text", "tab\there  two spaces\r\nline \x00 nul", "Released under the MIT License.\n" + PROSE,
        "cc by cc by CC-BY apache license, gnu  general public license", PROSE * 400, "w%%% x&&& y### z***", "<|endoftext|> it's o'clock don't.",
    ]
    rows = [(i, t, "en", "src", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, PROSE, None, None, None), (None, None, None, None, None), (3, "\n\n", "en", "src", 2), (7, PROSE, "en", "src", 1), (100, "a", None, "s", 1)]
    return rows


#: Names that the operators use themselves.
CLASHING = ["id", "row", "rk", "key", "n", "ids", "score", "bag", "hash", "size", "kept", "spans", "copies", "local", "marks", "url_host", "host", "path", "rule", "block", "vec", "part", "label_", "row_id"]


def with_clashes(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING if c not in df.columns))


def odd_documents(spark: SparkSession) -> DataFrame:
    return with_clashes(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3))


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def strings(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x: Counter, y: Counter) -> float:
    either = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in either) for i in x.keys() & y.keys())


def near_classes(rows: list[tuple], threshold: float = 0.8) -> list[int]:
    """The smallest place of each row's class."""
    parent = list(range(len(rows)))

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    bags = [strings(r[1]) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            alike = probability_jaccard(bags[a], bags[b]) >= threshold if bags[a] and bags[b] else not bags[a] and not bags[b] and (rows[a][1] or "") == (rows[b][1] or "")
            if alike:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(len(rows))]


def repeated_spans(texts: list[str | None], length: int = 200) -> list[list[tuple[int, int]]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans: list[list[int]] = []
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out
