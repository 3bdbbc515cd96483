"""Chunks that end in punctuation give the library's ids, whatever letter stands before it."""

from __future__ import annotations

import random

import pytest
from test_texts import BYTE, WORD
from tokenizers import Tokenizer

from motorspark.llm import chunks


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_random_words_with_punctuation(path, spaces):
    rng = random.Random(6)
    letters = "aZéİıßΣςΩǅǆ日٣9́ﬁŉẞ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) + "".join(rng.choices(".,;:!?|#$%&*()", k=rng.randint(0, 2))) for _ in range(rng.randint(1, 4))) for _ in range(20000)]
    flat, sizes = chunks.ChunkEncoder(path, spaces, specials=True).encode(texts)
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert flat.tolist() == [i for w in wanted for i in w]


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_random_capitals_marks_and_added_tokens(path, spaces):
    rng = random.Random(5)
    parts = ["A", "b", "THE", "The", "İ", "H", "J", "\u0331", "\u030c", "É", "ß", "ΑΣ", "\u212a", "\u212b", "日本", "'S", "it's", "12", " ", "  ", ".", "!?", "\n"]
    parts += ["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(20000)]
    flat, sizes = chunks.ChunkEncoder(path, spaces, specials=True).encode(texts)
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert flat.tolist() == [i for w in wanted for i in w]
