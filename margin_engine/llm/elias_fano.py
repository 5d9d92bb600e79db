"""Elias-Fano sequences in numpy, and levels kept in a memory-mapped file."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence of unsigned integers below ``universe``: about 2 + log2(universe / n)
    bits each.  ``arrays()`` are its parts; successor search and access are vectorised."""

    def __init__(self, n: int, width: int, low, high, zeros):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values, n = values.astype(np.uint64), len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        w = np.uint64(width)
        low = np.zeros((n * width + 127) // 64 + 1, dtype=np.uint64)
        if width and n:
            part = values & ((_ONE << w) - _ONE)
            bit = np.arange(n, dtype=np.uint64) * w
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + w > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (values >> w).astype(np.int64)
        size = n + (max(0, universe - 1) >> width) + 2
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, width, low, high, zeros)

    def arrays(self):
        return [self.low, self.high, self.zeros]

    def _nth(self, k: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit of ``words``, of which ``before`` counts those ahead of each word."""
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.int64)
        bits = words[word]
        at = np.zeros(len(k), dtype=np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> at) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = rest >= count
            rest -= np.where(go, count, 0)
            at += np.where(go, np.uint64(step), np.uint64(0))
        return word * 64 + at.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        return self._nth(k, self.zeros, ~self.high)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th elements."""
        if not len(i):
            return np.zeros(0, dtype=np.uint64)
        i = i.astype(np.int64)
        ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros
        top = self._nth(i, ones, self.high) - i
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | second) & ((_ONE << np.uint64(self.width)) - _ONE)

    def successor(self, value: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of the first element >= value (n where there is none); values below the universe.
        With ``first`` and ``last`` the search stays in first <= index < last, and is ``last`` where none is there."""
        value = value.astype(np.uint64)
        top = (value >> np.uint64(self.width)).astype(np.int64)
        begin = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - top + 1, 0)
        end = self._zero(top) - top
        want = value & ((_ONE << np.uint64(self.width)) - _ONE)
        lo, hi = begin.copy(), end.copy()
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def find(self, value: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of an element equal to value (in first <= index < last where given), -1 where there is none."""
        if not self.n or not len(value):
            return np.full(len(value), -1, dtype=np.int64)
        at = self.successor(value, first, last)
        top = (value.astype(np.uint64) >> np.uint64(self.width)).astype(np.int64)
        inside = at < self._zero(top) - top
        if first is not None:
            inside &= at < last
        hit = inside.copy()
        hit[inside] = self._lows(at[inside]) == (value[inside].astype(np.uint64) & ((_ONE << np.uint64(self.width)) - _ONE))
        return np.where(hit, at, -1)


class MappedLevels:
    """Arrays written one after another to a task-local file that is memory-mapped and has no
    name any more (it goes when the mapping goes)."""

    def __init__(self, arrays: list[np.ndarray]):
        fd, path = tempfile.mkstemp(prefix="levels-")
        try:
            with os.fdopen(fd, "wb") as f:
                at, places = 0, []
                for a in arrays:
                    f.write(b"\0" * (-at % 8))
                    at += -at % 8
                    places.append(at)
                    f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
                    at += a.nbytes
                f.write(b"\0" * 8)
            mapped = np.memmap(path, dtype=np.uint8, mode="r")
        finally:
            os.unlink(path)
        self.bytes = at
        self.arrays = [mapped[p:p + a.nbytes].view(a.dtype) for p, a in zip(places, arrays)]
