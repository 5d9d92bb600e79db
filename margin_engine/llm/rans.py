"""Static range asymmetric numeral system over token ids, in numpy.

``Table`` is the shared frequency table: counts scaled to 2^18, at least 1 for
every id that occurs.  A block of ids goes round-robin to ``LANES`` interleaved
64-bit states that emit 32-bit words.  Every ``STEP`` symbols a lane, the
states and the word position are a checkpoint, from which decoding can begin:
a decoder runs all segments of a block side by side.  Block layout
(little-endian): magic, n, segments; word position of each segment; lane states of
each segment; words; crc32 of the ids is kept beside and verified on reading.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES, STEP = 512, 256
MAGIC = b"RANS"
_LOW = np.uint64(1 << 31)
_U32, _SCALE, _MASK = np.uint64(32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)


class Table:
    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        """Ids with their positive counts; at most 2^18 ids."""
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.int64)
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        total, goal = max(1, int(counts.sum())), 1 << SCALE
        if len(ids) > goal:
            raise ValueError("more ids than slots")
        freq = np.maximum(1, counts.astype(np.float64) * goal // total).astype(np.int64)
        rest = goal - int(freq.sum())
        if len(ids) and rest > 0:
            freq[np.argmax(freq)] += rest
        while rest < 0:  # take from the largest what the ones of rare ids cost
            j = int(np.argmax(freq))
            cut = min(-rest, int(freq[j]) // 2)
            freq[j] -= cut
            rest += cut
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = freq
        self.start[ids] = np.cumsum(freq) - freq
        self.slot = np.repeat(ids, freq).astype(np.uint32)


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    segments = -(-steps // STEP)
    grid = np.zeros(steps * LANES, dtype=np.int64)
    grid[:n] = ids
    freq, start = table.freq[grid].reshape(steps, LANES), table.start[grid].reshape(steps, LANES)
    words = np.zeros((steps, LANES), dtype=np.uint32)
    sent = np.zeros((steps, LANES), dtype=bool)
    states = np.zeros((segments, LANES), dtype=np.uint64)
    x = np.full(LANES, _LOW, dtype=np.uint64)
    for t in range(steps - 1, -1, -1):
        live = LANES if t < steps - 1 else n - t * LANES
        f, y = freq[t, :live], x[:live]
        out = y >= (f << np.uint64(31 - SCALE + 32))
        words[t, :live] = y & np.uint64(0xFFFFFFFF)
        sent[t, :live] = out
        y = np.where(out, y >> _U32, y)
        q, r = np.divmod(y, f)
        x[:live] = (q << _SCALE) + r + start[t, :live]
        if t % STEP == 0:
            states[t // STEP] = x
    count = sent.sum(axis=1)
    position = np.concatenate([[0], np.cumsum(count)])[:-1][::STEP].astype("<u4")
    return MAGIC + struct.pack("<QI", n, segments) + position.tobytes() + states.astype("<u8").tobytes() + words[sent].astype("<u4").tobytes()


def decode(data: bytes, table: Table) -> np.ndarray:
    """All segments side by side, each from its own checkpoint."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    n, segments = struct.unpack_from("<QI", data, 4)
    if not n:
        return np.zeros(0, np.uint32)
    at = 16
    position = np.frombuffer(data, "<u4", segments, at).astype(np.int64)
    at += 4 * segments
    x = np.frombuffer(data, "<u8", segments * LANES, at).reshape(segments, LANES).copy()
    words = np.frombuffer(data, "<u4", offset=at + 8 * segments * LANES)
    words = np.append(words, np.zeros(1, np.uint32))
    steps = -(-n // LANES)
    out = np.zeros((segments, STEP, LANES), dtype=np.uint32)
    lane = np.arange(LANES)
    for t in range(min(STEP, steps)):
        live = (np.arange(segments)[:, None] * STEP + t) * LANES + lane < n
        slot = x & _MASK
        symbol = table.slot[slot]
        y = table.freq[symbol] * (x >> _SCALE) + slot - table.start[symbol]
        need = (y < _LOW) & live
        take = np.cumsum(need, axis=1)
        word = words[np.minimum(position[:, None] + take - 1, len(words) - 1)]
        x = np.where(live, np.where(need, (y << _U32) | word, y), x)
        position += take[:, -1]
        out[:, t] = symbol
    if (x[-1] != _LOW).any():
        raise ValueError("damaged token block")
    return out.reshape(-1)[:n]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
