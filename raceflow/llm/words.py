"""Whole Arrow batches of texts as arrays of hashed words (numpy, no per-word Python).

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. A word's
64-bit hash is mixed from eight bytes at a time, so two different words share one with
probability 2**-64. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)
PART_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER_GAP = np.ones(256, dtype=bool)
LETTER_GAP[65:91] = LETTER_GAP[97:123] = LETTER_GAP[128:] = False
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over all bits (one-to-one)."""
    h = (h ^ (h >> SHIFT)) * FINISH
    h = (h ^ (h >> SHIFT)) * FINISH
    return h ^ (h >> SHIFT)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, limit: int = PART_BYTES):
    """(first, after-last) row ranges of at most ``limit`` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, after
        first = after


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = (lengths.astype(np.uint64) + np.uint64(1)) * MULTIPLY
    left, at, who = lengths.copy(), starts.copy(), None
    while len(left):
        chunk = eight[at] & KEEP[np.minimum(left, 8)]
        if who is None:
            h = (h ^ chunk) * MULTIPLY
            h ^= h >> SHIFT
            who = np.flatnonzero(left > 8)
        else:
            x = (h[who] ^ chunk) * MULTIPLY
            h[who] = x ^ (x >> SHIFT)
            who = who[left > 8]
        more = left > 8
        left, at = left[more] - 8, at[more] + 8
    return mix(h)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Start, length and row of every word; ``gap`` marks the bytes between words."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends - starts, rows


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets into them) of the lower-cased words of each row."""
    starts, lengths, rows = spans(data, offsets)
    hashes = hash_spans(LOWER[data], starts, lengths)
    bounds = np.searchsorted(rows, np.arange(len(offsets)), side="left")
    return hashes, bounds


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-word sequences, in order; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    h = np.full(n - size + 1, size, dtype=np.uint64) * FINISH
    for k in range(size):
        h = (h ^ words[k:n - size + 1 + k]) * MULTIPLY
        h ^= h >> SHIFT
    return mix(h)


def shingle_rows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all ``size``-word sequences inside a row; shorter rows give none."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n - size + 1, size, dtype=np.uint64) * FINISH
    for k in range(size):
        h = (h ^ words[k:n - size + 1 + k]) * MULTIPLY
        h ^= h >> SHIFT
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = rows[:n - size + 1] == rows[size - 1:]
    return mix(h[inside]), rows[:n - size + 1][inside]


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the sorted ``keys``, found?) for every wanted value."""
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def salted(h: np.ndarray, kind: int) -> np.ndarray:
    return mix(h ^ np.uint64(kind + 1))


class Letters:
    """Runs of letters (a-z, A-Z, all bytes beyond ASCII) of a part, and their character n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.lengths, self.rows = spans(data, offsets, LETTER_GAP)
        first = (data & 0xC0) != 0x80
        self.at = np.append(np.flatnonzero(first), len(data))
        before = np.concatenate([[0], np.cumsum(first)])
        self.first = before[self.starts]
        self.chars = before[self.starts + self.lengths] - self.first

    def words(self) -> np.ndarray:
        return salted(hash_spans(self.data, self.starts, self.lengths), 0)

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, word numbers) of the n-grams inside the words ``which``."""
        many = np.maximum(self.chars[which] - order + 1, 0)
        word = np.repeat(which, many)
        step = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        a = self.first[word] + step
        begin = self.at[a]
        return salted(hash_spans(self.data, begin, self.at[a + order] - begin), order), word

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, word numbers) of the first ``size`` characters of the words that have more."""
        which = np.flatnonzero(self.chars > size)
        a = self.first[which]
        return salted(hash_spans(self.data, self.starts[which], self.at[a + size] - self.starts[which]), size), which
