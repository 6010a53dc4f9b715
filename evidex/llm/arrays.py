"""Numpy helpers that run inside tasks: texts of an Arrow batch as bytes, words of such bytes, hashes, spanning links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes (a longer text is a run of its own): first row, last row, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes other than 0x20 and 0x09 to 0x0D) and, for each text, the first word's number (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    inside = at - np.repeat(starts, sizes)
    values = BYTE[data[at]] * powers(int(sizes.max()))[inside]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return mix(sums + sizes.astype(np.uint64) * BASE)


class Links:
    """Keeps, of links between numbered rows, those that join two parts not yet joined (and few more): a linear number with the same components."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the links to be kept."""
        p = self.parent
        ra, rb = p[a], p[b]
        new = np.flatnonzero(ra != rb)
        if not len(new):
            return new
        high, low = np.maximum(ra[new], rb[new]), np.minimum(ra[new], rb[new])
        _, once = np.unique(high * np.int64(len(p)) + low, return_index=True)
        new, high, low = new[once], high[once], low[once]
        np.minimum.at(p, high, low)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.parent = p
        return new
