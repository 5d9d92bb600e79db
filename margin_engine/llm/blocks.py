"""Vectorised word blocks for Arrow tasks.

Spark partitions, shuffles and aggregates; inside a task these helpers turn
a block of whole texts into word positions and 64-bit word hashes with numpy.
A block holds at most ``max_bytes`` of text, or a single longer text, so a
task's memory is bounded by the longest document and not by its partition.

Word classes act on UTF-8 bytes: every byte of a non-ASCII character is
>= 0x80, so a class that keeps all non-ASCII characters can be applied to
bytes without decoding.  Null texts count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased bytes).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


class _Powers:
    """P^i and P^-i mod 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size, p, np.uint64)])) for p in (_PRIME, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * P^i (mod 2^64), one longer than values."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of each range [start, end) of the hashed values."""
    _, down = _POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


class Block:
    """Texts of some rows: their bytes, words and word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self):
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, kind: np.ndarray, lower: bool = True) -> "Block":
        """Find words; sets ``starts``, ``ends`` (bytes), ``first`` (row i has the words
        ``first[i]`` to ``first[i+1]``) and ``hashes``."""
        data = LOWER[self.data] if lower else self.data
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.offsets] = True
        inside = kind[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = ranges_hash(prefix_sums(_BYTES[data]), self.starts, self.ends)
        return self

    def windows(self, size: int):
        """(row, word index, hash) of each window of ``size`` words inside a row."""
        n = np.diff(self.first)
        per = np.maximum(n - size + 1, 0)
        row = np.repeat(np.arange(len(self)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + self.first[row]
        return row, at, ranges_hash(self.word_sums(), at, at + size)

    def word_sums(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = prefix_sums(self.hashes)
        return self._sums


def blocks(batch: pa.RecordBatch, text_col: str, max_bytes: int = BLOCK_BYTES):
    """Yield (row slice of the batch, Block) pairs, each of bounded bytes."""
    column = batch.column(batch.schema.get_field_index(text_col))
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield batch.slice(i, j - i), Block(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j
