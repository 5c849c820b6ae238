"""Words of whole Arrow batches as numpy arrays: no Python object per word.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r. Its hash is a polynomial in a table of
mixed byte values; hashes of word sequences are polynomials in word hashes, read off prefix sums. All arithmetic is
modulo 2^64 and every result is passed through a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15 | 5
_PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... (n values)."""
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset of each row (nulls are empty)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about ``most``, cut behind white space (a longer word is not cut)."""
    i, n = 0, len(data)
    while i < n:
        j = i + most
        while j < n:
            space = np.flatnonzero(SPACE[data[j : j + most]])
            if len(space):
                j += int(space[0]) + 1
                break
            j += most
        j = min(j, n)
        yield i, j
        i = j


class Words:
    """The words of rows: ``start`` and ``stop`` in bytes, ``hash``, and ``first``, the first word of each row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hashes: bool = True):
        starts, stops, values = [], [], []
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        for i, j in _pieces(data, _PIECE):
            part = data[i:j]
            word = ~SPACE[part]
            begin = word.copy()
            begin[1:] &= ~word[:-1] | cut[i + 1 : j]
            end = word
            end[:-1] &= ~word[1:] | cut[i + 1 : j]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            if len(begin):
                starts.append(begin + i)
                stops.append(end + i)
                if hashes:
                    values.append(_hash(part, begin, end))
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.stop = np.concatenate(stops) if stops else none
        self.hash = np.concatenate(values) if values else none.astype(U)
        self.first = np.searchsorted(self.start, bounds)


def _hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    at = np.arange(size.sum(), dtype=np.int64)
    head = np.cumsum(size) - size
    place = at - np.repeat(head, size)  # in the word
    values = _TABLE[data[place + np.repeat(begin, size)]] * powers(_BYTE_BASE, int(size.max()))[place]
    return mix(np.add.reduceat(values, head) + size.astype(U))


class Sequences:
    """Hashes of any range of consecutive words, by one subtraction."""

    def __init__(self, words: np.ndarray, base: int):
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * powers(base, len(words)), out=self.sums[1:])
        self.back = powers(inverse(base), len(words) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U))
