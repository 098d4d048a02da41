"""Whole-batch word arrays: the words of many texts as 64-bit hashes, without a Python loop over words.

Words are runs of ``[^\\x20\\x09-\\x0D]``; every byte of UTF-8 outside ASCII belongs to a word. Hashes are
64 bits wide: two of n different words share one with a probability near n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, made longer when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)

            def powers(b: int) -> np.ndarray:
                out = np.full(size, b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``size`` bytes together, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that make up one chunk: a hash for each word, in order, and where each text's words begin and end.

    With ``lower``, A-Z count as a-z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)  # before these bytes a word can't go on
    cut[offsets] = True
    first = word & cut[:n]
    first[1:] |= word[1:] & ~word[:-1]
    last = word & cut[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[_LOWER[data] if lower else data] * up, out=sums[1:])
    hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


_STEPS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; of fewer words, one for the whole sequence; of none, none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out += words[i : n - width + 1 + i] * _STEPS[i]
    return mix64(out)
