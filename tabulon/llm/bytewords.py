"""Words of many texts at once, found and hashed on their UTF-8 bytes with numpy.

A batch of texts is one byte array; a word is a maximal run of bytes that a table marks as word bytes.
White space is ASCII in every table, so cutting at bytes is cutting at characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: Lower case of A-Z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 20)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = _Powers()


@dataclass
class Words:
    """Words of a chunk of texts. start, end: byte places; text: index of the text; hash: 64 bits of each word's bytes."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    sums: np.ndarray | None = None

    def hashes(self, size: int | None = None) -> np.ndarray:
        """Of each whole word, or of its first `size` bytes."""
        if self.sums is None:
            _POWERS.grow(len(self.data))
            self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * _POWERS.up[: len(self.data)], out=self.sums[1:])
        end = self.end if size is None else np.minimum(self.end, self.start + size)
        return mix((self.sums[end] - self.sums[self.start]) * _POWERS.down[self.start] + (end - self.start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """data: bytes of all texts; bounds: where each text begins, and the end."""
    n = len(bounds) - 1
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    last = bounds[1:][bounds[1:] > 0] - 1
    stops[last] = inside[last]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, np.flatnonzero(stops) + 1, np.repeat(np.arange(n), np.diff(first)), first)


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive rows of a string column; nulls are empty. A text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_MIXERS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles of `size` words as sorted 64-bit hashes (signed). A-Z are lower-cased; a shorter text is one shingle; without words the set is empty."""
    for i, j, data, bounds in chunks(column):
        w = words(LOWER[data], bounds, NOT_SPACE)
        h = w.hashes()
        n = max(0, len(h) - size + 1)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            key += h[k : k + n] * _MIXERS[k]
        key = mix(key).view(np.int64)
        first = w.first
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= size:
                yield np.unique(key[a : b - size + 1])
            elif b > a:
                yield mix(np.sum(h[a:b] * _MIXERS[: b - a], keepdims=True) + _MIXERS[-1:] * _U(b - a)).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
