"""The tokenizers library with a memory: each different chunk of text is encoded once.

Both byte-level and word vocabularies cut a text before they merge, at known places of white space and where letters or
digits meet punctuation. So all chunks of many texts are found at once in their bytes (``word_table``), chunks met before
are looked up, and only new ones go through the library. A vocabulary that drops white space has words as chunks; else a
chunk may begin with the space before it, and white space that belongs to no word is a chunk of its own. Texts with other
white space than spaces and line ends, or with an added token that counts as one, go through whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np

from motorspark.llm.common import held
from motorspark.llm.word_table import GAP, PUNCTUATION, SHORT, WordTable, piece_bounds, word_bounds, word_keys

#: White space other than space and line end, as Python or the library's patterns see it.
ODD_SPACE = re.compile(
    r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
)
MARK = re.compile(r"[\u0300-\u036f]")
#: Chunks kept in memory as rows of arrays; those of more than ``SHORT`` bytes, which a dictionary holds, count twice.
KEPT = 1_500_000


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """``encode`` gives what the library's ``encode_batch(texts, add_special_tokens=False)`` gives, as one flat array."""

    def __init__(self, path: str, spaces: bool, limit: int | None = None, specials: bool = False):
        """``spaces``: the vocabulary encodes white space; else it is dropped. ``limit`` (default: ``KEPT``) bounds the chunks kept in memory.

        ``specials``: strings of added tokens in a text become their one id, as the library does by default; else they are ordinary text.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.added_bytes = [a.encode() for a in self.added]
        self.vocabulary = self.library.get_vocab_size()
        self.model, self.letters = self.library.model, byte_letters()
        self.spaces, self.limit = spaces, limit or KEPT
        self.parts: dict[str, bytes] = {"": b""}
        self.forget()

    def forget(self) -> None:
        """Drops the chunks, and their parts only once these are as many."""
        self.places: dict[bytes, int] = {}
        self.table, self.numbered, self.chunks = WordTable(), np.zeros(1 << 14, np.int64), 0
        if len(self.parts) > self.limit:
            self.parts = {"": b""}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def body(self, text: str) -> bytes | None:
        """The bytes to take the chunks of a text from, or None if it has to go through whole."""
        if ODD_SPACE.search(text) or any(a in text for a in self.added):
            return None
        if self.spaces:
            return text.encode()
        # the vocabulary is of lower case, so spellings of one word share a chunk; no added token may come of it,
        # and a mark after a letter may only have one sign together with it in one of the cases
        raw = text.encode()
        low = raw if not text.isascii() and MARK.search(text) else raw.lower()
        return raw if any(a in low for a in self.added_bytes) else low

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def simple(self, part: str) -> bool:
        """A word that is one unit to either vocabulary, and stays so in lower case: letters of Latin-1, a space before them."""
        word = part[1:] if part[0] == " " else part
        return word.isalpha() and (word.isascii() or max(word) < "\u0100")

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        bases, tails = [], []
        for raw in chunks:
            base = raw.rstrip(PUNCTUATION)
            # lower case may end in a mark (as of U+0130), which goes with the punctuation
            if len(base) < len(raw) and (base if base.isascii() else base.lower()).removeprefix(" ").isalnum():
                bases.append(base)
                tails.append(raw[len(base) :])
            else:
                bases.append(raw)
                tails.append("")
        parts, tokenize, spaces, letters = self.parts, self.model.tokenize, self.spaces, self.letters
        others = []
        for part in {*bases, *tails}.difference(parts):
            if not self.simple(part):
                others.append(part)
                continue
            # a simple word goes without the library's passes before and after the merges
            word = part if spaces else part.lower()
            word = word.replace(" ", letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(letters)
            parts[part] = array("I", [t.id for t in tokenize(word)]).tobytes()
        for part, ids in zip(others, self.library_ids(others), strict=True):
            parts[part] = array("I", ids).tobytes()
        return [parts[b] + parts[t] for b, t in zip(bases, tails, strict=True)]

    def keep(self, found: list[bytes]) -> range:
        """Takes the ids of new chunks into memory, and gives their places there."""
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        first, total = self.chunks, self.used + len(flat)
        self.chunks += len(found)
        while len(self.pool) < total:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.starts) < self.chunks:
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : total] = flat
        self.sizes[first : self.chunks] = sizes
        self.starts[first : self.chunks] = self.used + np.cumsum(sizes) - sizes
        self.used = total
        return range(first, self.chunks)

    def by_string(self, chunks: list[bytes]) -> np.ndarray:
        """The places of chunks, by a dictionary."""
        places = np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(missed := np.flatnonzero(places < 0)):
            every = [chunks[i] for i in missed.tolist()]
            new = list(dict.fromkeys(every))
            self.places.update(zip(new, self.keep(self.chunk_ids([c.decode() for c in new])), strict=True))
            places[missed] = np.fromiter(map(self.places.__getitem__, every), np.int64, len(every))
        return places

    def by_key(self, buffer: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of chunks of up to ``SHORT`` bytes."""
        low, high = word_keys(buffer, starts, sizes)
        numbers = self.table.find(low, high)
        if len(missed := np.flatnonzero(numbers < 0)):
            every = [buffer[s : s + n] for s, n in zip(starts[missed].tolist(), sizes[missed].tolist(), strict=True)]
            new = dict(zip(every, missed.tolist(), strict=True))
            at = np.fromiter(new.values(), np.int64, len(new))
            self.table.add(low[at], high[at])
            places = self.keep(self.chunk_ids([w.decode() for w in new]))
            while len(self.numbered) < self.table.n:
                self.numbered = np.concatenate([self.numbered, np.zeros_like(self.numbered)])
            self.numbered[self.table.n - len(new) : self.table.n] = places
            self.parts = {"": b""}  # the table has them
            numbers[missed] = self.table.find(low[missed], high[missed])
        return self.numbered[numbers]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each.

        Nothing here refers to itself, so the collector of such objects rests meanwhile.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.looked_up(texts)
        finally:
            if collecting:
                gc.enable()

    def chunk_places(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The texts that go through whole, the places of the chunks of all others, and the number of chunks before each text and in all."""
        bodies = [self.body(t) for t in texts]
        buffer = GAP.join([b"", *(b or b"" for b in bodies), GAP * 16])
        starts, ends = (piece_bounds if self.spaces else word_bounds)(np.frombuffer(buffer, np.uint8))
        sizes = ends - starts
        places = np.empty(len(starts), np.int64)
        short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        places[short] = self.by_key(buffer, starts[short], sizes[short])
        places[long] = self.by_string([buffer[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        text_ends = np.cumsum([len(b or b"") + 1 for b in bodies])
        return [i for i, b in enumerate(bodies) if b is None], places, np.concatenate([[0], np.searchsorted(starts, text_ends)])

    def looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.chunks + len(self.places) > self.limit:
            self.forget()
        whole, places, chunk_ends = self.chunk_places(texts)
        sizes = self.sizes[places]
        flat = self.pool[np.repeat(self.starts[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(ends[chunk_ends])
        if whole:
            found = dict(zip(whole, self.library_ids([texts[i] for i in whole]), strict=True))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            flat = np.concatenate([np.asarray(found[i], np.uint32) if i in found else flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))])
            counts[whole] = [len(found[i]) for i in whole]
        return flat, counts


def encoder(path: str, spaces: bool, specials: bool = False) -> ChunkEncoder:
    """One encoder for each worker process: later tasks find what earlier ones learned."""
    return held((path, spaces, specials), lambda: ChunkEncoder(path, spaces, specials=specials))


def portions(texts: Iterable[str | None], most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null: empty) of about ``most`` characters together, with the place of the first."""
    first, held, size = 0, [], 0
    for place, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = place + 1, [], 0
    if held:
        yield first, held
