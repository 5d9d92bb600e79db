"""Suffix-array dedup: bytes covered by a repeated ``LENGTH``-byte string go.

1. Every window of ``LENGTH`` bytes of a document has an anchor: the start of its
   least ``GRAM``-byte gram by hash (leftmost of equals), a function of the
   window's bytes alone, so equal windows have equal anchors.  Consecutive
   windows of one anchor form a row; about 1 % of positions are anchors.
2. Grams are counted over all documents (map-side combined).  A row whose gram
   occurs once cannot hold a repeated window.  Grams that occur more often are marked in
   a bitmap of bounded size (at most 2^28 bits) that is broadcast; a
   mark too many only sends a suffix in vain.
3. The marked rows' suffixes (from the anchor on, with the bytes before it) are
   sorted in each map task into runs, equal ones merged with their
   places, and front-coded: common prefix length and the rest.  Runs go by gram
   hash to merge tasks, where a loser tree merges them: it carries the common
   prefix length of every waiting suffix with the last winner and never
   compares a known prefix again.
4. Merged suffixes that share ``GRAM`` bytes form a group; in it, windows that occur at two
   places or more are repeated, and their bytes are removed.
5. Grams above ``HOT`` occurrences leave no group of unbounded size: each of their windows becomes a row
   keyed by two 64-bit hashes, counted by Spark with map-side combining.

Windows in a group are compared by 64-bit hashes.  Defined cases: a null or empty text
has no bytes; texts shorter than ``LENGTH`` lose nothing; a null doc_id is a document; repeated rows
repeat each other's strings; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import _BYTES, blocks, mix, prefix_sums, ranges_hash

LENGTH, GRAM = 400, 128
_SPAN = LENGTH - GRAM + 1  # at most 512: a place in a block takes nine bits
HOT = 20_000
RUN_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
CHUNK_BYTES = 2 << 20
MAX_BITS = 28
_SECOND = mix(_BYTES)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(anchor, first window, last window, gram hash, doc) of each row of windows, positions in ``data``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data)
    sizes = np.diff(offsets)
    per = np.maximum(sizes - LENGTH + 1, 0)
    total = int(per.sum())
    if not total:
        return none
    sums = prefix_sums(_BYTES[data])
    at = np.arange(n - GRAM + 1)
    grams = ranges_hash(sums, at, at + GRAM)
    blocks_ = -(-n // _SPAN)
    packed = np.full(blocks_ * _SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[:len(grams)] = grams & ~np.uint64(0x1FF)
    packed = packed.reshape(blocks_, _SPAN)
    packed |= np.arange(_SPAN, dtype=np.uint64)
    forward = np.minimum.accumulate(packed, axis=1).ravel()
    backward = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    doc = np.repeat(np.arange(len(sizes)), per)
    start = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + offsets[:-1][doc]
    left, right = backward[start], forward[start + _SPAN - 1]
    nine, low = np.uint64(9), np.uint64(0x1FF)
    first = (left >> nine) <= (right >> nine)
    anchor = np.where(first, start // _SPAN * _SPAN + (left & low).astype(np.int64),
                      (start + _SPAN - 1) // _SPAN * _SPAN + (right & low).astype(np.int64))
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], total) - 1
    return anchor[begin], start[begin], start[end], grams[anchor[begin]], doc[begin]


def _count(batches):
    held, size = [], 0

    def merged():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["gram", "n"])

    for batch in batches:
        for _, block in blocks(batch, "text", 1 << 20):
            keys, counts = np.unique(anchors(block.data, block.offsets)[3].astype(np.uint64), return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > 2_000_000:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A sorted, front-coded run of suffixes: (prefix shared with the one before, suffix, bytes before, places)."""

    KINDS = ("<u2", "<u2", "<u2", "<u4", "<i8", "<i8", "<i8", "u1")

    @staticmethod
    def pack(entries) -> bytes:
        """``entries``: sorted [(suffix, bytes before, [(k1, k2, first window)])]."""
        prefix, rest, left, count, places, raw, last = [], [], [], [], [], [], b""
        for suffix, before, where in entries:
            shared = common_prefix(last, suffix)
            prefix.append(shared), rest.append(len(suffix) - shared), left.append(len(before)), count.append(len(where))
            places.extend(where)
            raw.append(suffix[shared:]), raw.append(before)
            last = suffix
        places = np.array(places, dtype=np.int64).reshape(-1, 3)
        cols = [prefix, rest, left, count, places[:, 0], places[:, 1], places[:, 2], np.frombuffer(b"".join(raw), np.uint8)]
        cols = [np.asarray(c).astype(k) for c, k in zip(cols, Run.KINDS)]
        head = np.array([len(c) for c in cols], "<u8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in cols))

    def __init__(self, packed: bytes):
        data = zstandard.ZstdDecompressor().decompress(packed)
        at, cols = 64, []
        for n, kind in zip(np.frombuffer(data, "<u8", 8), self.KINDS):
            cols.append(np.frombuffer(data, kind, int(n), at))
            at += cols[-1].nbytes
        self.prefix, self.rest, self.left, self.count = (c.tolist() for c in cols[:4])
        self.places = np.stack(cols[4:7], axis=1)
        self.raw = cols[7].tobytes()
        self.i, self.at, self.place, self.suffix = -1, 0, 0, b""

    def step(self) -> int:
        """Move to the next suffix; its common prefix with the one before, -1 at the end."""
        if self.i >= 0:
            self.place += self.count[self.i]
        self.i += 1
        if self.i == len(self.prefix):
            return -1
        i, at = self.i, self.at
        shared = self.prefix[i]
        mid = at + self.rest[i]
        self.suffix = self.suffix[:shared] + self.raw[at:mid]
        self.at = mid + self.left[i]
        self.before = self.raw[mid:self.at]
        return shared

    def where(self) -> np.ndarray:
        return self.places[self.place:self.place + self.count[self.i]]


def merge(runs: list[Run]):
    """Loser tree over sorted runs: yields (common prefix with the one before, run at its suffix)."""
    k = len(runs)
    known = [0] * k  # common prefix of each waiting suffix with the last winner; -1: run is over
    for i, r in enumerate(runs):
        known[i] = -1 if r.step() < 0 else 0

    def play(i: int, j: int):
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        if i < 0 or j < 0:
            return (j, i) if i < 0 else (i, j)
        a, b = known[i], known[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = runs[i].suffix, runs[j].suffix
        n = common_prefix(x, y, a)
        if x[n:n + 1] <= y[n:n + 1]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    size = 1 << max(0, (k - 1).bit_length())
    losers, level = [-1] * size, [i if i < k else -1 for i in range(size)]
    while len(level) > 1:
        half = len(level) // 2
        nxt = []
        for m in range(half):
            win, lose = play(level[2 * m], level[2 * m + 1])
            losers[half + m] = lose
            nxt.append(win)
        level = nxt
    winner = level[0]
    while winner >= 0 and known[winner] >= 0:
        yield known[winner], runs[winner]
        known[winner] = runs[winner].step()
        node = (size + winner) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def _runs(bitmap, bits: int, hot, buckets: int):
    def run(batches):
        marks, hot_grams = bitmap.value, hot.value
        held: dict[int, dict] = {}
        size = 0

        def flush():
            ids, blobs = [], []
            for bucket, entries in held.items():
                ordered = sorted((s, b, w) for (s, b), w in entries.items())
                ids.append(bucket)
                blobs.append(Run.pack(ordered))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "run"])

        for batch in batches:
            for rows, block in blocks(batch, "text", 1 << 20):
                anchor, lo, hi, gram, doc = anchors(block.data, block.offsets)
                gram = gram.astype(np.uint64)
                bit = (gram >> np.uint64(64 - bits)).astype(np.int64)
                pick = (marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if len(hot_grams):
                    pick &= ~np.isin(gram, hot_grams)
                pick = np.flatnonzero(pick)
                k1, k2 = (rows.column(i).to_numpy() for i in (0, 1))
                data = block.data.tobytes()
                bucket = (mix(gram[pick]) % np.uint64(buckets)).tolist()
                row, first = doc[pick], lo[pick] - block.offsets[doc[pick]]
                for b, a, s, e, x, y, p in zip(bucket, anchor[pick].tolist(), lo[pick].tolist(), hi[pick].tolist(),
                                               k1[row].tolist(), k2[row].tolist(), first.tolist()):
                    held.setdefault(b, {}).setdefault((data[a:e + LENGTH], data[s:a]), []).append((x, y, p))
                    size += e + LENGTH - s
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


_REMOVED = "k1 bigint, k2 bigint, start bigint, stop bigint"


def _repeated(texts, groups, places):
    """Removed ranges (k1, k2, start, stop) of merged entries: windows that occur twice in their group."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    per = sizes - LENGTH + 1
    entry = np.repeat(np.arange(len(texts)), per)
    index = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = index + begin[entry]
    keys = ranges_hash(prefix_sums(_BYTES[data]), at, at + LENGTH) ^ mix(np.asarray(groups, dtype=np.uint64))[entry]
    count = np.array([len(p) for p in places])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    cuts = np.flatnonzero(new)
    sums = np.add.reduceat(count[entry[order]], cuts)
    twice = np.zeros(len(keys), dtype=bool)
    twice[order] = np.repeat(sums, np.diff(np.append(cuts, len(keys)))) > 1
    edge = twice.copy()
    edge[1:] &= ~(twice[:-1] & (entry[1:] == entry[:-1]))
    start = np.flatnonzero(edge)
    edge = twice.copy()
    edge[:-1] &= ~(twice[1:] & (entry[1:] == entry[:-1]))
    stop = np.flatnonzero(edge)
    owner = entry[start]
    every = np.concatenate(places)
    first = np.cumsum(count) - count
    n = count[owner]
    member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[owner], n)
    a, b = np.repeat(index[start], n), np.repeat(index[stop], n)
    p = every[member]
    return p[:, 0], p[:, 1], p[:, 2] + a, p[:, 2] + b + LENGTH


def _merge_bucket(table: pa.Table) -> pa.Table:
    runs = [Run(r.as_buffer().to_pybytes()) for r in table["run"]]
    out = []
    texts, groups, places, size, group = [], [], [], 0, 0

    def flush():
        if len(texts) > 1 or (texts and len(places[0]) > 1):
            out.append(pa.table([pa.array(c) for c in _repeated(texts, groups, places)], names=["k1", "k2", "start", "stop"]))
        texts.clear(), groups.clear(), places.clear()

    pending = None  # an entry that may stay alone in its group

    def take(run):
        nonlocal size
        texts.append(run[0])
        groups.append(group)
        places.append(run[1])
        size += len(run[0])

    for shared, run in merge(runs):
        entry = (run.before + run.suffix, run.where())
        if shared < GRAM:
            if pending is not None and len(pending[1]) > 1:
                take(pending)
            pending = None
            group += 1
            if size > CHUNK_BYTES:
                flush()
                size = 0
            pending = entry
        else:
            if pending is not None:
                take(pending)
                pending = None
            take(entry)
    if pending is not None and len(pending[1]) > 1:
        take(pending)
    flush()
    empty = pa.table([pa.array([], pa.int64())] * 4, names=["k1", "k2", "start", "stop"])
    return pa.concat_tables([empty, *out])


def _holders(block, hot_grams):
    """Rows of the block that hold a hot gram anywhere (anchors are grams, so no other row matters)."""
    data = block.data
    if len(data) < GRAM:
        return np.zeros(0, np.int64)
    at = np.arange(len(data) - GRAM + 1)
    grams = ranges_hash(prefix_sums(_BYTES[data]), at, at + GRAM)
    marks = np.zeros(1 << 16, dtype=bool)
    marks[(hot_grams >> np.uint64(48)).astype(np.int64)] = True
    some = np.flatnonzero(marks[(grams >> np.uint64(48)).astype(np.int64)])
    some = some[np.isin(grams[some], hot_grams)]
    return np.unique(np.searchsorted(block.offsets, some, side="right") - 1)


def _hot_windows(hot):
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, "text", 1 << 20):
                held = _holders(block, hot.value)
                if not len(held):
                    continue
                sizes = np.diff(block.offsets)[held]
                offsets = np.append(0, np.cumsum(sizes))
                data = np.concatenate([block.data[block.offsets[i]:block.offsets[i + 1]] for i in held.tolist()])
                _, lo, hi, gram, doc = anchors(data, offsets)
                pick = np.flatnonzero(np.isin(gram.astype(np.uint64), hot.value))
                per = hi[pick] - lo[pick] + 1
                at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(lo[pick], per)
                row = np.repeat(doc[pick], per)
                k1, k2 = (rows.column(i).to_numpy()[held[row]] for i in (0, 1))
                h = [ranges_hash(prefix_sums(t[data]), at, at + LENGTH).view(np.int64) for t in (_BYTES, _SECOND)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*h, k1, k2, at - offsets[row])], names=["h1", "h2", "k1", "k2", "start"])

    return run


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(k1, k2, start, stop): byte ranges covered by repeated strings, of rows (k1, k2, text)."""
    spark = keyed.sparkSession
    grams = materialize(keyed.mapInArrow(_count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")
    distinct, rows = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(MAX_BITS, max(20, (32 * max(1, distinct)).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - bits)
    # 2^bits marks in pieces of 32768 (Spark's bitmap functions), at most 2^MAX_BITS in all
    pieces = grams.groupBy(F.shiftright(place, 15).cast("int").alias("piece")).agg(
        F.bitmap_construct_agg((place % 32768).cast("bigint")).alias("bits")).collect()
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in pieces:
        bitmap[r["piece"] * 4096:r["piece"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    limit = max(HOT, rows // 1_000_000)  # so at most a million grams are hot
    hot = np.array([r["gram"] for r in grams.filter(F.col("n") > int(limit)).select("gram").collect()], dtype=np.int64).view(np.uint64)
    bitmap, hot_set = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(np.sort(hot))
    buckets = max(1, -(-rows * (LENGTH + _SPAN // 2) // BUCKET_BYTES))
    removed = keyed.mapInArrow(_runs(bitmap, bits, hot_set, buckets), "bucket int, run binary").groupBy(
        "bucket").applyInArrow(_merge_bucket, _REMOVED)
    if len(hot):
        # the texts are looked at once: the windows are counted and joined from the table written here
        windows = materialize(keyed.mapInArrow(_hot_windows(hot_set), "h1 bigint, h2 bigint, k1 bigint, k2 bigint, start bigint"), "hot-windows")
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        removed = removed.union(windows.join(twice, ["h1", "h2"]).select("k1", "k2", "start", (F.col("start") + LENGTH).alias("stop")))
    return removed


def _cut(batches):
    for batch in batches:
        for rows, block in blocks(batch, "text", 4 << 20):
            ranges = rows.column(rows.schema.get_field_index("ranges"))
            removed, spans, digest, kept = [], [], [], []
            for i in range(len(block)):
                raw = block.text(i)
                if ranges[i].is_valid:
                    own = ranges[i].values
                    start, stop = own.field("start").to_numpy(), own.field("stop").to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    new = np.ones(len(start), dtype=bool)
                    new[1:] = start[1:] > stop[:-1]  # touching runs are one
                    begin = np.flatnonzero(new)
                    a, b = start[begin], stop[np.append(begin[1:], len(start)) - 1]
                    at, parts = 0, []
                    for s, e in zip(a.tolist(), b.tolist()):
                        parts.append(raw[at:s])
                        at = e
                    own_kept = b"".join([*parts, raw[at:]])
                    spans.append(len(a))
                else:
                    own_kept = raw
                    spans.append(0)
                removed.append(len(raw) - len(own_kept))
                digest.append(hashlib.sha256(own_kept).hexdigest())
                kept.append(own_kept)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` are the remaining bytes."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("k1"),
                        F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("k2"), F.col(text_col).alias("text"),
                        F.col(id_col).cast("bigint").alias("doc_id"))
    ranges = repeated_ranges(keyed.select("k1", "k2", "text")).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges"))  # copies of a row name the same ranges
    return keyed.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).drop("kept")
