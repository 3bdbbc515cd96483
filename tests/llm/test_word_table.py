"""Words found in bytes and remembered by their bytes: the library's ids, and each word learned once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from test_texts import BYTE, WORD
from tokenizers import Tokenizer

from motorspark.llm import chunks, token_files
from motorspark.llm.word_table import WordTable, piece_bounds, word_bounds, word_keys


def test_a_word_is_learned_once_whatever_punctuation_follows():
    coder, learned = chunks.ChunkEncoder(WORD, False, specials=True), []
    learn = coder.chunk_ids
    coder.chunk_ids = lambda words: learned.extend(words) or learn(words)
    for text in ("Word word, (word) WORD. word", "word? word! a:word|"):
        flat, _ = coder.encode([text])
        assert flat.tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    assert sorted(learned) == sorted(["word", ",", "(", ")", ".", "?", "!", "a", ":", "|"])


def test_a_word_with_its_space_is_learned_once_whatever_punctuation_follows():
    coder, learned = chunks.ChunkEncoder(BYTE, True, specials=True), []
    learn = coder.chunk_ids
    coder.chunk_ids = lambda words: learned.extend(words) or learn(words)
    for text in ("a word, word. (word) word's word", "word word: word! a\nword; word\n"):
        flat, _ = coder.encode([text])
        assert flat.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert sorted(learned) == sorted(["a", " word", ",", ".", " (", "word", ")", " word's", ":", "!", " a", "\n", ";"])


def test_pieces_in_bytes_give_the_library_ids():
    rng = random.Random(12)
    alphabet = [*"aZ9z", *".,;:!?|#$%&*()", *"-'\"<>/=_~", *"éßİΣς日٣²ﬁ—…", "́", "̸", "\u200d", "\x00", *"     \n\n", "\n\n", "  ", " \n", "'s", "'LL", "'t", "é,", "abcdefghijklmn", " abcdefghijklmno", "<|endoftext|", "<|EndOfText|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(6000)]
    texts += [a + w + c for n in (6, 7, 8, 13, 14, 15, 16, 17) for a in ("", " ", "\n") for w in ("q" * n, "é" * n, "q" * (n - 1) + "\x00", " " * n, "\n" * n) for c in ("", ".", "\x00", " ", "\n", "\nq")]
    wanted = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    for coder in (chunks.ChunkEncoder(BYTE, True, specials=True), chunks.ChunkEncoder(BYTE, True, limit=50, specials=True)):
        for first in range(0, len(texts), 500):
            flat, sizes = coder.encode(texts[first : first + 500])
            assert sizes.tolist() == [len(w) for w in wanted[first : first + 500]]
            assert flat.tolist() == [i for w in wanted[first : first + 500] for i in w]
    # spaces and line ends send no text through whole; other white space and added tokens do
    assert coder.chunk_places(["a  b", "\n\na \n", "", " ", "a\tb", "a\rb", "a<|endoftext|>"])[0] == [4, 5, 6]


def test_words_in_bytes_give_the_library_ids():
    rng = random.Random(11)
    alphabet = [*"aZ9z", *".,;:!?|#$%&*()", *"-'\"<>/=_~", *"éßİΣς日٣²ﬁ—…", "́", "̸", "‍", "\x00", " ", " ", "\n", "\n\n", "\t", "'s", "'LL", "é,", "abcdefghijklmno", "ABCDEFGHIJKLMNOP", "<|endoftext|>", "<|EndOfText|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(6000)]
    texts += [w + c for n in (7, 8, 9, 14, 15, 16, 17) for w in ("q" * n, "é" * n, "q" * (n - 1) + "\x00") for c in ("", ".", "\x00", " ")]
    wanted = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    for coder in (chunks.ChunkEncoder(WORD, False, specials=True), chunks.ChunkEncoder(WORD, False, limit=50, specials=True)):
        for first in range(0, len(texts), 500):
            flat, sizes = coder.encode(texts[first : first + 500])
            assert sizes.tolist() == [len(w) for w in wanted[first : first + 500]]
            assert flat.tolist() == [i for w in wanted[first : first + 500] for i in w]


def test_texts_without_pieces():
    coder = chunks.ChunkEncoder(BYTE, True, specials=True)
    for texts in ([], [""], ["", ""]):
        flat, sizes = coder.encode(texts)
        assert flat.tolist() == [] and sizes.tolist() == [0] * len(texts)


def test_texts_without_words():
    coder = chunks.ChunkEncoder(WORD, False, specials=True)
    for texts in ([], [""], ["", " ", "\n"], ["\t"]):
        flat, sizes = coder.encode(texts)
        assert flat.tolist() == [] and sizes.tolist() == [0] * len(texts)


def test_keys_are_told_apart_while_the_table_grows():
    words = sorted({bytes(x) for x in np.random.default_rng(2).integers(0, 3, (30_000, 15), np.uint8)} | {b"\x00" * n for n in range(1, 16)})
    sizes = np.array([len(w) for w in words])
    low, high = word_keys(b"".join(words) + bytes(16), np.cumsum(sizes) - sizes, sizes)
    table = WordTable()
    for part in np.array_split(np.arange(len(words)), 7):
        assert (table.find(low[part], high[part]) == -1).all()
        table.add(low[part], high[part])
        assert table.find(low[: part[-1] + 1], high[: part[-1] + 1]).tolist() == list(range(part[-1] + 1))
    table.first_slot = lambda low, high: np.zeros(len(low), np.int64)  # all keys meet in one slot
    table.n, table.slots = 0, np.full(1 << 15, -1, np.int32)
    table.add(low[:200], high[:200])
    assert table.find(low[:300], high[:300]).tolist() == [*range(200), *[-1] * 100]


def test_bounds_of_words():
    data = np.frombuffer(b" ab,c -. x.-y 1)\n", np.uint8)
    starts, ends = word_bounds(data)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b",", b"c", b"-.", b"x", b".-y", b"1", b")"]


def test_bounds_of_pieces():
    data = np.frombuffer(b"\r ab,c  -. x.-y\n1)\n\nd \n e\n\r\r \n\rf\r\r", np.uint8)
    starts, ends = piece_bounds(data)
    wanted = [b" ab", b",", b"c", b" ", b" -.", b" x", b".-y", b"\n", b"1", b")", b"\n", b"\n", b"d", b" \n", b" e", b"\n", b" \n", b"f"]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == wanted
    assert all(len(x) == 0 for x in piece_bounds(np.frombuffer(b"\r\r\r", np.uint8)))


def test_ids_of_both_widths_are_read_in_runs():
    rows = [np.array([1, 2], "<u2"), np.array([3], "<u2"), np.array([70_000, 4], "<u4"), np.array([5], "<u2"), np.array([], "<u4")]
    batch = pa.record_batch([pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["n", "ids"])
    assert [x.tolist() for x in token_files.flat_ids(batch)] == [[1, 2, 3], [70_000, 4], [5]]
    assert [x.tolist() for x in token_files.flat_ids(batch.slice(1, 2))] == [[3], [70_000, 4]]
    assert list(token_files.flat_ids(batch.slice(0, 0))) == []
