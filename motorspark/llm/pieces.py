"""SentencePiece encoding and decoding: batched Viterbi search in numpy.

The pieces and scores of a SentencePiece model are read from its file. A text becomes words, each with the meta space it
begins with; no piece of the vocabulary crosses the beginning of a word. The different words of a batch are searched
together, all words of one length at once: at every place the hashes of all substrings that end there are looked up
among the sorted hashes of the pieces, the best sum of scores so far is a maximum over their lengths, and its length is
the backpointer. What no piece covers is written as bytes. Decoding joins the pieces and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorspark.llm.chunks import portions
from motorspark.llm.common import held

SPACE = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Score of an unknown character below the least score of a piece.
PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A vocabulary: ``encode`` gives the ids of the best segmentation of each text, ``decode`` the text of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = [list(fields(value)) for number, value in fields(file.read()) if number == 1]
        self.names, scores, self.kinds = [], [], []
        for part in parts:
            cells = dict(part)
            self.names.append(cells[1].decode())
            scores.append(np.frombuffer(cells.get(2, b"\0\0\0\0"), "<f4")[0])
            self.kinds.append(cells.get(3, NORMAL))
        normal = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        if any(SPACE in self.names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece crosses the beginning of a word")
        self.bytes_of = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        self.longest = max((len(self.names[i]) for i in normal), default=1)
        hashes = np.array([self.hash_of(self.names[i]) for i in normal], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.key_ids = hashes[order], np.array(normal, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.scores = np.array(scores, np.float64)
        self.floor = (self.scores[normal].min() if normal else 0.0) - PENALTY
        self.known: dict[str, bytes] = {}

    @staticmethod
    def hash_of(piece: str) -> int:
        state = np.zeros(1, np.uint64)
        for c in piece:
            state = mixed(state * BASE + np.uint64(ord(c) + 1))
        return int(state[0])

    def words(self, text: str) -> list[str]:
        """The text with a space before it and spaces made visible, cut before each run of spaces."""
        marked = (SPACE + text.replace(" ", SPACE)) if text else ""
        if SPACE + SPACE not in marked:
            return [SPACE + w for w in marked.split(SPACE)[1:]]
        cuts = [i for i in range(len(marked)) if marked[i] == SPACE and (i == 0 or marked[i - 1] != SPACE)]
        return [marked[a:b] for a, b in zip(cuts, [*cuts[1:], len(marked)], strict=True)]

    def search(self, codes: np.ndarray) -> list[list[int]]:
        """Best segmentations of words of one length, given as a matrix of code points (words x length)."""
        n, length = codes.shape
        best = np.zeros((length + 1, n))
        step = np.ones((length + 1, n), np.int64)
        piece = np.full((length + 1, n), -1, np.int64)
        # hashes of the substrings that end at the last place, longest first; each step lets all grow by one character
        state = np.zeros((0, n), np.uint64)
        for end in range(1, length + 1):
            state = np.concatenate([state, np.zeros((1, n), np.uint64)])[-self.longest :]
            state = mixed(state * BASE + (codes[:, end - 1].astype(np.uint64) + np.uint64(1)))
            found = np.minimum(np.searchsorted(self.keys, state), len(self.keys) - 1)
            hit = self.keys[found] == state if len(self.keys) else np.zeros(state.shape, bool)
            spans = np.arange(len(state), 0, -1)
            ids = np.where(hit, self.key_ids[found], -1)
            total = np.where(hit, self.scores[ids] + best[end - spans], -np.inf)
            single = ~hit[-1]
            total[-1] = np.where(single, self.floor + best[end - 1], total[-1])
            top = total.argmax(0)  # the first of equals: the longest piece
            best[end], step[end] = total[top, np.arange(n)], spans[top]
            piece[end] = ids[top, np.arange(n)]
        out = []
        for row in range(n):
            ids, end = [], length
            while end:
                own = int(piece[end, row])
                if own >= 0:
                    ids.append(own)
                else:
                    ids += [self.bytes_of.get(b, self.unknown) for b in reversed(chr(codes[row, end - 1]).encode("utf-8", "surrogatepass"))]
                end -= int(step[end, row])
            out.append(ids[::-1])
        return out

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            portion = max(1, 4_000_000 // (length * 24 + self.longest * 64))
            for at in range(0, len(group), portion):
                own = group[at : at + portion]
                codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length)
                for word, ids in zip(own, self.search(codes), strict=True):
                    self.known[word] = np.array(ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.words(t) for t in texts]
        self.learn(list({w for s in split for w in s}.difference(self.known)))
        known = self.known.__getitem__
        return [b"".join(map(known, s)) for s in split]

    @property
    def surfaces(self) -> list[bytes]:
        if not hasattr(self, "_surfaces"):
            self._surfaces = [
                bytes([self.byte_at[i]]) if k == BYTE else b"" if k == CONTROL else n.replace(SPACE, " ").encode() for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True))
            ]
        return self._surfaces

    def decode(self, ids: bytes) -> str:
        surfaces = self.surfaces
        text = b"".join([surfaces[i] for i in np.frombuffer(ids, np.uint32).tolist()])
        return text.decode("utf-8", "replace").removeprefix(" ")


def vocabulary(path: str) -> Pieces:
    return held(path, lambda: Pieces(path))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids) of every whole text: the segmentation with the largest sum of scores; ids are little-endian unsigned 32-bit.

    A null text is empty and has no ids. The model adds a space before a text and drops none. A text that holds the sign
    for a space itself comes back with spaces in its place. Other columns are not read; repeated rows and null ids stay.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            for first, texts in portions(batch.column("text").to_pylist(), 1 << 20):
                ids = pieces.encode(texts)
                yield pa.record_batch([batch.column("id").slice(first, len(ids)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, n long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(id, n, ids, text) of (id, n, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = pa.array([pieces.decode(i.as_buffer().to_pybytes()) for i in part.column("ids")], pa.string())
                yield pa.record_batch([part.column("id"), part.column("n"), part.column("ids"), texts], names=["id", "n", "ids", "text"])

    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, n long, ids binary, text string")
