"""Hashes over the raw bytes of an Arrow text column, computed for a whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; a null text has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches, column: int, limit: int = 1 << 20):
    """Slices of record batches with about ``limit`` bytes of text; at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


class Prefix:
    """Polynomial sums over a byte array, from which the hash of any substring follows."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        n = len(data)
        if len(Prefix._powers) < n + 1:
            grown = np.full(n + 1, _BASE, dtype=np.uint64)
            grown[0] = 1
            Prefix._powers = np.multiply.accumulate(grown)
            grown = np.full(n + 1, _INVERSE, dtype=np.uint64)
            grown[0] = 1
            Prefix._inverses = np.multiply.accumulate(grown)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * Prefix._powers[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end): equal for equal bytes, wherever they are."""
        raw = (self.sums[ends] - self.sums[starts]) * Prefix._inverses[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _STEPS[0])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every substring of ``width`` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[width : width + n] - self.sums[:n]) * Prefix._inverses[:n] + _STEPS[1])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    Words are runs without ASCII white space, with A-Z made lower case. A text with fewer words has
    one shingle, the whole sequence; one without words has none. ``width`` is 24 at most.
    """
    data, offsets = text_bytes(column)
    n = len(data)
    empty = np.empty(0, dtype=np.uint64)
    if not n:
        return [empty] * len(column)
    inked = ~_BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~inked[:-1]
    starts = np.flatnonzero(inked & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~inked[1:]
    ends = np.flatnonzero(inked & (after | edge[1:])) + 1
    words = Prefix(data, _BYTE[_LOWER]).hashes(starts, ends)
    bounds = np.searchsorted(starts, offsets)  # first word of each text
    out = []
    m = len(words) - width + 1
    if m > 0:
        rolled = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + m] * _STEPS[1 + k]
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            h = np.sort(rolled[a : b - width + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            terms = np.append(words[a:b] * _STEPS[1 : 1 + b - a], _STEPS[40 + b - a])
            out.append(mix(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(empty)
    return out
