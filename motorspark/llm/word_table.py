"""Words of a byte buffer, and the numbers of those met before, found for all words of a buffer at once.

Texts stand in a buffer between carriage returns, which none of them holds. A word of up to 15 bytes is its own key: its
bytes and its length in two 64-bit numbers, so equal keys are equal words.
"""

from __future__ import annotations

import string

import numpy as np

SHORT = 15
GAP = b"\r"
PUNCTUATION = ".,;:!?|#$%&*()"
WHITE, MARK, ALNUM, OTHER = 0, 1, 2, 4
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*b" \n" + GAP]], KINDS[[*PUNCTUATION.encode()]], KINDS[[*(string.ascii_letters + string.digits).encode()]] = WHITE, MARK, ALNUM
#: The first ``n`` bytes of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that begin and end with white space.

    Words stand between white space, and are cut where an ASCII letter or digit meets punctuation.
    """
    kinds = KINDS[data]
    last, now = kinds[:-1], kinds[1:]
    cut = last * now == MARK * ALNUM
    starts = np.flatnonzero((now != WHITE) & ((last == WHITE) | cut)) + 1
    return starts, np.flatnonzero((last != WHITE) & ((now == WHITE) | cut)) + 1


def piece_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of bytes that begin and end with a gap between texts; pieces cover all of every text.

    Cuts are those of words, but a space goes with the word after it. A line end before a word is a piece, and so is other
    white space between two words but for the last sign, or all of it at the end of a text.
    """
    kinds, gap = KINDS[data], data == GAP[0]
    white = (kinds == WHITE) & ~gap
    cut = kinds[:-2] * kinds[1:-1] == MARK * ALNUM
    cut |= white[1:-1] & (~white[:-2] | (kinds[2:] != WHITE))
    cut |= (data[:-2] == ord("\n")) & (kinds[1:-1] != WHITE)
    starts = (cut | gap[:-2]) & ~gap[1:-1]
    return np.flatnonzero(starts) + 1, np.flatnonzero((starts | gap[1:-1]) & ~gap[:-2]) + 1


def word_keys(padded: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of words of up to ``SHORT`` bytes; 16 bytes follow the last word in ``padded``."""
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    low = eights[starts] & MASKS[np.minimum(sizes, 8)]
    return low, eights[starts + 8] & MASKS[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)


class WordTable:
    """Numbers keys from 0 on in the order they are added."""

    def __init__(self):
        self.n, self.low, self.high = 0, np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.slots = np.full(1 << 15, -1, np.int32)  # at most half of them are filled

    def first_slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self.first_slot(low, high)
        found = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high)))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & len(self.slots) - 1
            found[open_] = got = self.slots[slot]
            on = (got >= 0) & ((self.low[got] != low[open_]) | (self.high[got] != high[open_]))
            open_, slot = open_[on], slot[on]
        return found

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Adds different keys, none of which is there yet."""
        first, self.n = self.n, self.n + len(low)
        while len(self.low) < self.n:
            self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high))
        self.low[first : self.n], self.high[first : self.n] = low, high
        if 2 * self.n > len(self.slots):
            first, self.slots = 0, np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
        numbers = np.arange(first, self.n, dtype=np.int32)
        slot = self.first_slot(self.low[first : self.n], self.high[first : self.n])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], slot[left] + 1 & len(self.slots) - 1
