"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Texts are never turned
into Python strings; a 64-bit hash stands for a word. It is a polynomial of the bytes modulo 2**64,
taken as a difference of prefix sums and then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20  # bytes hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class _Powers:
    """Powers of the base and of its inverse, as long as the longest block so far."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up = _powers(BASE, n)
            self.down = _powers(pow(BASE, -1, 1 << 64), n)
        return self.up, self.down


POWERS = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, dtype=np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Byte range and hash of each word; the words of text ``i`` are ``bounds[i]`` to ``bounds[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    data: np.ndarray  # the lower-cased bytes


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word ends where its text does
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        lo, hi = start[at], end[upto - 1]
        up, down = POWERS.to(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=total[1:])
        s, e = start[at:upto] - lo, end[at:upto] - lo
        hashed[at:upto] = mix((total[e] - total[s]) * down[s])
        at = upto
    return Words(start, end, hashed, np.searchsorted(start, offsets), data)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(BASE) + hashes[i:n - width + 1 + i]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sequence of words."""
    n = len(hashes)
    up, _ = POWERS.to(n + 1)
    one = int((hashes * up[:n]).sum(dtype=np.uint64))
    two = int((mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) * up[1:n + 1]).sum(dtype=np.uint64))
    return signed(one + n), signed(two + n)


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value
