"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, runs of 48 words (longer ones in a text of more than 512 passages, so that a bag is
bounded and the text whole). Every passage is described by shares of characters and words and encoded by a dense layer;
gated attention, learned from document labels alone, weighs the passages; the weighted mean is scored. Features and scores
are computed in Arrow batches on the executors; the few thousand weights are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorspark.llm.common import text_parts

PASSAGE, PASSAGES = 48, 512
HIDDEN, GATE = 24, 12
BUCKETS = 32
#: Labelled rows that the weights are fitted on, at most.
SAMPLE = 6000
MIX = np.uint64(0x9E3779B97F4A7C15)


def character_classes() -> np.ndarray:
    """Small letters, capitals, digits, control characters and bytes beyond ASCII are a class each; so is every other character."""
    classes = np.zeros(256, np.int64)
    others = [b for b in range(32, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        classes[b] = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if b > 127 else 3
    classes[others] = 5 + np.arange(len(others))
    return classes


CLASSES = character_classes()
KINDS = int(CLASSES.max()) + 1
WORD_FACTS = 7
FEATURES = KINDS + WORD_FACTS + BUCKETS


def passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and features of every passage; a text without words is one passage."""
    n = len(starts)
    space = data <= 32
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    head = ~space & np.concatenate([[True], space[:-1]]) | ~space & edge[:-1]
    begin = np.flatnonzero(head)
    stop = np.minimum(np.append(begin[1:], len(data)), ends[np.searchsorted(starts, begin, side="right") - 1])
    owner = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(owner, minlength=n)
    long = np.maximum(PASSAGE, -(-words // PASSAGES))
    place = np.arange(len(begin)) - (np.cumsum(words) - words)[owner]
    per_text = np.maximum(1, -(-words // long))
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(n), per_text)
    of_word = first[owner] + place // long[owner]
    total = len(text)
    # bytes of a passage: from its first word, or the text's beginning, to the next passage
    opens = begin[(place % long[owner] == 0) & (place > 0)]
    bounds = np.sort(np.concatenate([starts, opens]))
    of_byte = np.repeat(np.arange(total), np.diff(np.append(bounds, len(data))))
    chars = np.bincount(of_byte * KINDS + CLASSES[data], minlength=total * KINDS).reshape(total, KINDS).astype(np.float64)
    amount = np.maximum(1, chars.sum(1))
    # words: a hash by rolling sums, and what can be told by comparing neighbours
    rolling = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) ** 3, dtype=np.uint64)])
    spaces = np.concatenate([[0], np.cumsum(space)])
    letters = stop - begin - (spaces[stop] - spaces[begin])
    capitals = np.concatenate([[0], np.cumsum(CLASSES[data] == 1)])
    upper = capitals[begin + letters] - capitals[begin]
    last = CLASSES[data[begin + letters - 1]] if len(begin) else np.zeros(0, np.int64)
    head_byte, tail_byte = (data[begin], data[begin + letters - 1]) if len(begin) else (np.zeros(0, np.uint8),) * 2
    value = (rolling[begin + letters] - rolling[begin]) * MIX + letters.astype(np.uint64) * np.uint64(1009) + head_byte * np.uint64(31) + tail_byte
    same = np.zeros(len(begin))
    for back in range(1, 5):
        same[back:] = np.maximum(same[back:], (value[back:] == value[:-back]) & (owner[back:] == owner[:-back]))
    again = np.zeros(len(begin))
    again[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    count = np.bincount(of_word, minlength=total)
    of = np.maximum(1, count)
    mean = lambda x: np.bincount(of_word, x, minlength=total) / of
    facts = np.column_stack([mean(letters) / 10, np.sqrt(mean(letters**2.0)) / 10, mean(again), mean(same), mean(upper >= np.maximum(2, letters - 3)), mean(last >= 4), np.log1p(count) / 4])
    hashed = (value * MIX >> np.uint64(40)) % np.uint64(BUCKETS)
    bags = np.bincount(of_word * BUCKETS + hashed.astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS) / of[:, None]
    return text, np.column_stack([np.sqrt(chars / amount[:, None]), facts, np.sqrt(bags)]).astype(np.float32)


@dataclass
class Model:
    """Encoder, gated attention and score; ``mean`` and ``scale`` bring features to one range."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, text: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w, out = self.weights, {"x": (x - self.mean) / self.scale}
        out["h"] = np.tanh(out["x"] @ w["E"] + w["e"])
        out["t"], out["g"] = np.tanh(out["h"] @ w["V"]), 1 / (1 + np.exp(-(out["h"] @ w["U"])))
        logit = (out["t"] * out["g"]) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, text, logit)
        power = np.exp(logit - top[text])
        out["attention"] = power / np.bincount(text, power, minlength=n)[text]
        out["z"] = np.zeros((n, HIDDEN))
        np.add.at(out["z"], text, out["attention"][:, None] * out["h"])
        out["p"] = 1 / (1 + np.exp(-(out["z"] @ w["c"] + w["b"])))
        return out

    def gradients(self, text: np.ndarray, y: np.ndarray, out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w, n = self.weights, len(y)
        error = (out["p"] - y) / n
        d_z = error[:, None] * w["c"]
        d_attention = (out["h"] * d_z[text]).sum(1)
        mean = np.bincount(text, d_attention * out["attention"], minlength=n)
        d_logit = out["attention"] * (d_attention - mean[text])
        d_t = d_logit[:, None] * w["a"] * out["g"] * (1 - out["t"] ** 2)
        d_g = d_logit[:, None] * w["a"] * out["t"] * out["g"] * (1 - out["g"])
        d_h = out["attention"][:, None] * d_z[text] + d_t @ w["V"].T + d_g @ w["U"].T
        d_in = d_h * (1 - out["h"] ** 2)
        return {
            "E": out["x"].T @ d_in, "e": d_in.sum(0), "V": out["h"].T @ d_t, "U": out["h"].T @ d_g,
            "a": ((out["t"] * out["g"]) * d_logit[:, None]).sum(0), "c": out["z"].T @ error, "b": error.sum(),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = 960, batch: int = 256, rate: float = 5e-3, decay: float = 1e-4) -> Model:
    """``steps`` steps of Adam on the logistic loss, as many for few rows as for many. Without rows, or with one label only, every score is the share of good rows (one half)."""
    random = np.random.default_rng(11)
    shapes = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": ()}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) if k not in "eb" else np.zeros(s) for k, s in shapes.items()}
    if not len(labels) or labels.min() == labels.max():
        weights["c"] = weights["c"] * 0
        share = labels.mean() if len(labels) else 0.5
        weights["b"] = np.array(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights)
    everything = np.concatenate(bags)
    model = Model(everything.mean(0), everything.std(0) + 0.02, weights)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    while step < steps:
        order = random.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            text = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            out = model.forward(np.concatenate([bags[i] for i in own]), text, len(own))
            step += 1
            speed = rate * max(0.0, 1 - step / steps) + 1e-4
            for k, g in model.gradients(text, labels[own], out).items():
                g = g + decay * weights[k] * (k not in "eb")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def described(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns and the features of each row's passages, as bytes of 32-bit floats."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, starts, ends in text_parts(batch.column("text")):
                text, x = passages(data, starts, ends)
                cuts = np.searchsorted(text, np.arange(n + 1))
                cells = pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.record_batch([*(batch.column(c).slice(first, n) for c in columns), cells], names=[*columns, "bag"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(describe, f"{kinds}, bag binary")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows, those with the smallest hash of the id. ``allowed`` is a condition on ``id``.

    Ids without label or with different labels teach nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(allowed & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    chosen = F.broadcast(known.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample))  # bounded by ``sample``
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    texts = texts.select("id", "y", "text").orderBy(F.xxhash64("id", F.lit(3)), "id", F.xxhash64("text")).limit(sample)
    rows = described(texts, ("id", "y")).select("y", "bag").toArrow()
    bags = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, FEATURES) for b in rows.column("bag")]
    return fit(bags, np.asarray(rows.column("y"), np.float64))


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns ``keep``) and score: how likely the label 1 is, for every whole text (null: empty)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, starts, ends in text_parts(batch.column("text")):
                text, x = passages(data, starts, ends)
                yield pa.record_batch([batch.column("row").slice(first, n), pa.array(model.forward(x, text, n)["p"])], names=["row", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def held_out(id_column: Column) -> Column:
    """One id in four, by its text's checksum: never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; predicted is 1 from ``threshold`` on.

    Null and empty texts are a bag of one empty passage and get a score as well. Repeated rows get the same score. Labels,
    ids and other columns are no input of a score. An empty table gives no rows.
    """
    model = train(docs, labels, ~held_out(F.col("id")), id_col, text_col, label_col)
    found = scored(docs, model, text_col, (id_col,))
    own = F.col("row")[id_col]
    return found.select(own.alias(id_col), held_out(own).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
