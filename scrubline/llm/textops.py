"""Words of many texts at once, with numpy on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are worked on at once.
SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, longer when needed."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + (SLICE >> 2))
            self.up, self.down = _powers(self.base, size), _powers(self.inv, size)
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = Powers(int(_P)), Powers(int(_Q))

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: ASCII that is neither letter nor digit separates; bytes of other characters belong to words.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(arr: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows and the end) of about ``most`` bytes; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    _, offs, data = arr.buffers()
    if not len(arr):
        return
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(start of each word, its end, its 64-bit hash, first word of each row and the end); no word spans two rows.

    With ``prefix``, also a hash of the first so many bytes of each word, at the end.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64), *([np.zeros(0, U64)] if prefix else []))
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = BYTE_POWERS.get(n)
    sums = np.zeros(n + 1, dtype=U64)
    x = (LOWER[data] if lower else data).astype(U64)
    x += U64(1)
    x *= up[:n]
    np.cumsum(x, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    more = [mix((sums[np.minimum(ends, starts + prefix)] - sums[starts]) * down[starts] + _Q)] if prefix else []
    return (starts, ends, hashes, np.searchsorted(starts, offsets), *more)


class Ranges:
    """64-bit hashes of runs of words, by content and not place."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = WORD_POWERS.get(n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def hash(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mix((self.sums[after] - self.sums[first]) * self.down[first])


def ngrams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``k`` words in a row, first run of each row and the end).

    A row of fewer than ``k`` words, but one at least, has one run: all its words.
    """
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    r, count = Ranges(hashes), np.diff(bounds)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    own = np.zeros(len(bounds), np.int64)
    np.cumsum(runs, out=own[1:])
    first = np.arange(own[-1]) + np.repeat(bounds[:-1] - own[:-1], runs)
    after = np.minimum(first + k, np.repeat(bounds[1:], runs))
    return r.hash(first, after), own
