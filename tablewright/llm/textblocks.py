"""Words, lines and their hashes for whole Arrow batches of text, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are taken together until a block has this many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def released(run: Callable) -> Callable:
    """`run` over the batches of a partition, after which the worker gives the memory it no longer uses back to the system."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1) modulo 2 ** 64, kept between blocks."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        steps = np.full(max(size, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = known
    return known[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Block:
    """Some whole texts: `data` their UTF-8 bytes, `bounds` the byte positions between them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self._sums = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every maximal run without white space."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        inside = ~SPACE[self.data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.empty(size, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(size, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, self.text_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the line break) and text number of every line."""
        breaks = np.flatnonzero(self.data == 10)
        filled = np.flatnonzero(np.diff(self.bounds) > 0)
        starts = np.sort(np.concatenate([self.bounds[filled], breaks + 1]))
        ends = np.sort(np.concatenate([self.bounds[filled + 1], breaks]))
        last = np.searchsorted(self.bounds[1:], ends, "left")
        return starts, ends, last

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, from one running polynomial sum."""
        if self._sums is None:
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.data] * powers(_BASE, len(self.data)), out=sums[1:])
            self._sums = sums
        back = powers(_INVERSE, len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * back[starts])

    def lengths(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points in each byte range."""
        points = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=points[1:])
        return points[ends] - points[starts]


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Block]]:
    """(first row, block) over a string column; a null text is an empty one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, "right")) - 1)
        last = min(last, len(texts))
        part = data[bounds[first]:bounds[last]]
        yield first, Block(lower_ascii(part) if lower else part, bounds[first:last + 1] - bounds[first])
        first = last


def grams(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every n words in a row and the place of its first word, within one text."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rolling = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        rolling = rolling * ODD + words[i:i + count]
    at = np.flatnonzero(of[:count] == of[n - 1:])
    return mix(rolling[at] + np.uint64(n)), at


def per_text(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sum of whole numbers per text."""
    return np.bincount(of, weights=values, minlength=n).astype(np.int64) if len(of) else np.zeros(n, dtype=np.int64)
