"""Whole-batch word and hash arithmetic over Arrow string columns (numpy, no Python loop over words).

A batch is cut into slices of bounded bytes, so memory doesn't grow with the batch; one text is never cut.
Hashes are 64-bit polynomial hashes over bytes with a final mix; equal bytes give equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most `limit` bytes, or one longer row. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-gap bytes within each row, and the number of runs before each row."""
    word = ~gap[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, at)


class Hasher:
    """Hashes of any spans of one slice, each in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_BASE_INVERSE, len(data) + 1)

    def raw(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The polynomial from power 0: raw(a+b) = raw(a) + base**len(a) * raw(b)."""
        return (self.sums[e] - self.sums[s]) * self.back[s]

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix(self.raw(s, e) + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def power(n: np.ndarray) -> np.ndarray:
    """base**n for an array of exponents."""
    return _power(_BASE, int(n.max(initial=0)) + 1)[n]


def spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Slots:
    """A growing map from 64-bit hashes to slot numbers, looked up by whole arrays. Starts anew beyond `limit` entries."""

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of sorted distinct hashes, and which are there."""
        if not len(self.keys):
            return np.zeros(len(u), np.int64), np.zeros(len(u), bool)
        at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        return self.slot[at], self.keys[at] == u

    def add(self, u: np.ndarray) -> np.ndarray:
        """New slots, in order, for sorted distinct hashes that aren't there."""
        new = np.arange(len(self.keys), len(self.keys) + len(u))
        at = np.searchsorted(self.keys, u)
        self.keys, self.slot = np.insert(self.keys, at, u), np.insert(self.slot, at, new)
        return new


class Memo:
    """Values of words, computed once a process: `compute(list of bytes)` gives an array with a row for each word."""

    def __init__(self, compute, limit: int = 400_000):
        self.compute, self.slots, self.values = compute, Slots(limit), None

    def __call__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slots.keys) + len(u) > self.slots.limit:
            self.slots.clear()
            self.values = None
        slot, there = self.slots.find(u)
        if not there.all():
            new = first[~there]
            made = self.compute(spans(data, s[new], e[new]))
            slot[~there] = self.slots.add(u[~there])
            n = len(self.slots.keys)
            if self.values is None or len(self.values) < n:
                grown = np.zeros((max(n, 2 * n if n < 1 << 19 else n + (1 << 18)), *made.shape[1:]), made.dtype)
                if self.values is not None:
                    grown[: n - len(new)] = self.values[: n - len(new)]
                self.values = grown
            self.values[n - len(new) : n] = made
        return self.values[slot][back]
