"""Token ids of a public byte-level BPE, exactly as the library encodes whole texts.

A text that holds only characters below U+0250 or of General Punctuation is
cut into the tokenizer's pre-tokens with numpy, every distinct pre-token of a
task is encoded once by the library's own model, and ids are gathered from
that dictionary (about ``CACHE`` entries; those not met lately are dropped beyond it).  Any other text, and any text that holds the content of an
added token (``<|endoftext|>``, one id), goes
through the library's ``encode`` whole.  Both ways give the same ids: merges
never cross pre-tokens; tests compare them.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from .blocks import _BYTES, Block, prefix_sums, ranges_hash

CACHE = 400_000
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each fast code point, 255 for the others."""
    import regex

    out = np.full(0x110000, 255, dtype=np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        ch = chr(c)
        out[c] = (_LETTER if regex.match(r"\p{L}", ch) else _NUMBER if regex.match(r"\p{N}", ch)
                  else _SPACE if regex.match(r"\p{White_Space}", ch) else _OTHER)
    return out


@functools.lru_cache(maxsize=1)
def _alphabet() -> dict:
    """Byte -> character of the byte-level alphabet: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def pretokens(cp: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens: flags over code points ``cp`` of classes ``kind``; ``doc`` flags text starts."""
    n = len(cp)
    last = np.append(doc[1:], True)
    change = doc.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    space = kind == _SPACE
    # the last of a white-space run before a word: a blank joins the word, another stands alone
    final = space & ~last
    final[:-1] &= kind[1:] != _SPACE
    start |= final
    joins = np.zeros(n, dtype=bool)
    joins[1:] = (final & (cp == 0x20))[:-1]
    start &= ~joins | doc
    # contractions begin at an apostrophe that begins a token
    at = np.flatnonzero((cp == 0x27) & start)
    for i in at:
        one = chr(cp[i + 1]) if i + 1 < n and not doc[i + 1] else ""
        two = one + chr(cp[i + 2]) if one and i + 2 < n and not doc[i + 2] else ""
        size = 1 if one in ("s", "t", "m", "d") and one else 2 if two in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return start


class Encoder:
    """Ids of pre-tokens, looked up by 64-bit hash in sorted arrays; only unseen pre-tokens go to the model, one by one."""

    def __init__(self, path: str):
        self.tokenizer, self.model = _tokenizer(path), _tokenizer(path).model
        self.classes = _classes()
        self.letters = np.array([_alphabet()[b] for b in range(256)], dtype="<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys = np.zeros(0, np.uint64)  # sorted; begin, size and used go along
        self.begin, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def _drop_unused(self):
        """Forget the pre-tokens not met since the last time."""
        keep = self.used
        size = self.size[keep]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.flat = self.flat[np.repeat(self.begin[keep], size) + step]
        self.keys, self.size, self.begin = self.keys[keep], size, np.cumsum(size) - size
        self.used = np.zeros(len(size), dtype=bool)

    def _learn(self, keys, data, starts, ends):
        text = self.letters[data].tobytes().decode("utf-32-le")  # one character a byte
        tokenize, ids, sizes = self.model.tokenize, [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            own = tokenize(text[s:e])
            sizes.append(len(own))
            ids += [t.id for t in own]
        size = np.array(sizes, dtype=np.int64)
        begin = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, np.array(ids, dtype=np.uint32)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin = keys[order], np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.used = np.concatenate([self.used, np.zeros(len(size), dtype=bool)])[order]

    def _find(self, keys):
        """Places of ``keys`` in the sorted keys, and which of them are there."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), dtype=bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the block's texts."""
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        data = block.data
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[cp]
        doc = np.zeros(len(cp), dtype=bool)
        begins = np.searchsorted(at, block.offsets)
        sizes = np.diff(begins)
        doc[begins[:-1][sizes > 0]] = True
        starts_cp = np.flatnonzero(pretokens(cp, kind, doc))
        starts = at[starts_cp]
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(block.offsets, starts, side="right") - 1
        slow = np.zeros(len(block), dtype=bool)
        odd = np.flatnonzero(kind == 255)
        slow[np.searchsorted(begins, odd, side="right") - 1] = True
        for content in self.added:
            k = raw.find(content)
            while k >= 0:
                slow[np.searchsorted(block.offsets, k, side="right") - 1] = True
                k = raw.find(content, k + 1)
        fast = ~slow[row]
        starts, ends, row = starts[fast], ends[fast], row[fast]
        keys, first, inverse = np.unique(ranges_hash(prefix_sums(_BYTES[data]), starts, ends),
                                         return_index=True, return_inverse=True)
        at_key, there = self._find(keys)
        if not there.all():
            if len(self.keys) + np.count_nonzero(~there) > CACHE:
                self._drop_unused()
                there = self._find(keys)[1]
            new = ~there
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
            at_key, _ = self._find(keys)
        self.used[at_key] = True
        token = at_key[inverse]
        size = self.size[token]
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids = self.flat[np.repeat(self.begin[token], size) + step]
        per = np.bincount(row, weights=size, minlength=len(block)).astype(np.int64)
        if slow.any():
            parts, done = [], np.concatenate([[0], np.cumsum(per)])
            for i in range(len(block)):
                if slow[i]:
                    own = self.tokenizer.encode(block.text(i).decode("utf-8"), add_special_tokens=False).ids
                    parts.append(np.array(own, dtype=np.uint32))
                    per[i] = len(own)
                else:
                    parts.append(ids[done[i]:done[i + 1]])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(per)])
