"""LM scoring with a sharded Elias-Fano n-gram trie.

Model: bigrams with a Dirichlet prior on the unigram base,
    p(w | v) = (c(v w) + MU * p1(w)) / (c(v) + MU),  p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
v being the word before (a begin mark before the first); it sums to 1 for every v.  The log splits
into a part of (v, w), known where w's bigrams are, and -log(c(v) + MU), known where v itself
was predicted; so one shuffle of the token stream both trains and scores:

1. Word counts over all training texts (map-side combined) give N, V and the
   ``HEAD`` most frequent words, broadcast with their counts (bounded).
2. A map block (``MAP_BYTES`` of text, or one longer text) ships each distinct pair once with
   its training count: a tail word's to a shard by the word, a head word's by (word before,
   word), so a word of a third of all tokens spreads over all shards and a pair, however
   often it occurs, costs its shard one entry a block.  Pairs travel packed: two-byte codes
   for head words, 64-bit hashes for the rest, zstd.
3. A shard sums its pairs' counts and builds its trie, path word -> word before:
   level 1 the sorted words, monotone pointers to their ranges, level 2 the
   ranks of the words before, each range raised by the end of the range before it (so the
   level stays monotone and its universe small), all Elias-Fano;
   values are log probabilities quantised to 16 bits.  The levels are one
   memory-mapped file without a name.  Each distinct
   pair is looked up once: two pointers give its word's range, the element before the range
   what to add, and a successor search inside the range finds it; unseen
   bigrams take the word's back-off value.
4. A shard answers each map block with one row: the values of the block's pairs.  A second
   grouping, by block, adds them up over the block's tokens (four bytes each, the pair's
   place among the block's pairs), so per-document work never meets in a shard.

Nothing is sampled or pruned: counts cover all training texts, whole.  A
shard holds the pairs of about ``SHARD_TOKENS`` tokens, or one entry a map block where a pair is
in every block.  Words, and pairs within a map block, are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null doc_id is
held in (trained on) and scored; repeated rows are trained on and scored each; an empty table
gives no rows; with no training text base_score and score are 0 where p1 is 1;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import SPACED, blocks, mix
from .elias_fano import EliasFano, MappedLevels
from .quality_model import held_out

MU = 500.0
HEAD = 65_000
SHARD_TOKENS = 1_500_000
MIN_SHARDS = 64  # keeps every core of a cluster busy on small inputs
MAP_BYTES = 4 << 20
END = np.uint64(0xE17D0F7E47)
BEGIN_CODE, TAIL_CODE = 65_534, 65_535
BINS = 65_535


def _tokens(block):
    """(row, hash) of each token: words, then one end a row."""
    block.words(SPACED)
    n = np.diff(block.first)
    hashes = np.insert(block.hashes, block.first[1:], END)
    return np.repeat(np.arange(len(block)), n + 1), hashes


def _count(batches):
    held, size = [], 0

    def merged():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["h", "c"])

    for batch in batches:
        for rows, block in blocks(batch, "text"):
            row, hashes = _tokens(block)
            out = rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            keys, counts = np.unique(hashes[~out[row]], return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > 2_000_000:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


class Head:
    """The most frequent words: sorted hashes and counts; the end token is always one."""

    def __init__(self, hashes, counts, n: int, v: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.n, self.v = hashes[order], counts[order], n, v
        self.end = int(np.searchsorted(self.hashes, END))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, TAIL_CODE).astype(np.uint16)

    def p1(self, counts):
        return (counts + 0.1) / (self.n + 0.1 * (self.v + 1))


_PAIRS = ("<u4", "<u2", "<u2", "<u8", "<u8")  # training counts, codes, hashes of tail words
_ANSWER = ("<f4", "<u4", "<i8")  # values, places of tail words' pairs, their training counts


_TOKENS = ("<u4",)
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(kinds, *parts) -> bytes:
    """Arrays as byte planes (all first bytes, all second bytes, ...), which zstd makes small."""
    parts = [np.ascontiguousarray(p, k) for p, k in zip(parts, kinds)]
    planes = b"".join(p.view("u1").reshape(len(p), -1).T.tobytes() for p in parts if len(p))
    return np.array([len(p) for p in parts], "<u4").tobytes() + _ZSTD.compress(planes, asbytes=True)


def _unpack(kinds, data: bytes):
    sizes, at, out = np.frombuffer(data, "<u4", len(kinds)).tolist(), 0, []
    each = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(_ZSTD.decompress(data[4 * len(kinds):], sum(n * e for n, e in zip(sizes, each)), asbytes=True), "u1")
    for n, e, kind in zip(sizes, each, kinds):
        out.append(np.ascontiguousarray(planes[at:at + n * e].reshape(e, n).T).reshape(-1).view(kind))
        at += n * e
    return out


def _posting(shared, shards: int):
    """Map side: head words' sums per row, each token's pair, and packed distinct pairs per shard."""

    def run(batches):
        head = shared.value
        log_p1 = np.log10(head.p1(head.counts))
        log_c = np.log10(head.counts + MU)
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for rows, block in blocks(batch, "text", MAP_BYTES):
                row, hashes = _tokens(block)
                out = rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
                code = head.codes(hashes)
                before = np.empty_like(hashes)
                before[1:] = hashes[:-1]
                code1 = np.empty_like(code)
                code1[1:] = code[:-1]
                first = np.concatenate([[True], row[1:] != row[:-1]])
                code1[first], before[first] = BEGIN_CODE, 0
                tail = code == TAIL_CODE
                known = ~tail
                is_end = hashes == END
                at = code[known].astype(np.int64)
                n = len(block)
                base = np.bincount(row[known], weights=log_p1[at], minlength=n)
                score = -np.bincount(row[known], weights=np.where(is_end[known], 0.0, log_c[at]), minlength=n)
                score -= np.log10(head.counts[head.end] + MU)  # the begin mark
                have = np.bincount(row[known], weights=head.counts[at] > 0, minlength=n).astype(np.int64)
                _, one, pair = np.unique(mix(hashes * np.uint64(3) + before), return_index=True, return_inverse=True)
                trained = np.bincount(pair, weights=~out[row], minlength=len(one)).astype(np.int64)
                shard = np.where(tail, hashes, mix(hashes * np.uint64(3) + before))[one] % np.uint64(shards)
                order = np.argsort(shard << np.uint64(32) | code[one].astype(np.uint64) << np.uint64(16) | code1[one])
                cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
                place = np.empty(len(order), dtype="<u4")
                place[order] = np.arange(len(order))
                ids, payloads = np.flatnonzero(np.diff(cuts)), []
                for s in ids:
                    pick = order[cuts[s]:cuts[s + 1]]
                    at = one[pick]
                    c1, c2 = code1[at], code[at]
                    payloads.append(_pack(_PAIRS, trained[pick], c1, c2, before[at][c1 == TAIL_CODE], hashes[at][c2 == TAIL_CODE]))
                none = [None] * len(ids)
                # the rows' own sums and tokens ride with one shard's pairs, a random one
                docs = pa.StructArray.from_arrays(
                    [rows.column(0).cast(pa.int64()), pa.array(out), pa.array(np.bincount(row, minlength=n)),
                     pa.array(have), pa.array(base), pa.array(score)], names=_OWN)
                docs = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), docs)
                own = pa.concat_arrays([pa.array(none, docs.type), docs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*ids, int(mix(np.array([key], np.uint64))[0]) % shards], pa.int32()), pa.array([key] * (len(ids) + 1), pa.int64()),
                     pa.array([*cuts[ids], None], pa.int64()), pa.array([*payloads, _pack(_TOKENS, place[pair])], pa.binary()), own],
                    names=["shard", "block", "first", "payload", "docs"])
                key += 1

    return run


_OWN = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
_DOCS = "docs array<struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,score:double>>"
_POSTED = f"shard int, block bigint, first bigint, payload binary, {_DOCS}"
_PARTIAL = f"block bigint, first bigint, payload binary, {_DOCS}"
_SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
           "base_score double, score double")


def _changes(*columns):
    """Where a row of sorted columns differs from the row before it."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Trie:
    """Words and the words before them with quantised log values (see the module's text)."""

    def __init__(self, word, before, count, head: Head, tail_only):
        """A shard's distinct pairs, sorted by word and word before, with training counts; ``tail_only``: (sorted tail
        words, their counts)."""
        new = _changes(word)
        words, contexts = word[new], np.unique(before)
        pointers = np.append(np.flatnonzero(new), len(word))
        rank = np.searchsorted(contexts, before)
        slot = np.cumsum(new) - 1
        # a range's ranks follow on the last value of the range before it
        tops = np.cumsum(rank[pointers[1:] - 1] + 1) if len(word) else np.zeros(0, np.int64)
        raised = rank + np.concatenate([[0], tops])[slot]
        self.span = max(1, len(contexts))
        code = head.codes(words)
        tails, tail_counts = tail_only
        self.counts = np.where(code == TAIL_CODE, tail_counts[np.minimum(np.searchsorted(tails, words), max(0, len(tails) - 1))]
                               if len(tails) else 0, head.counts[np.minimum(code, len(head.counts) - 1)])
        prior = MU * head.p1(self.counts)
        value = np.log10(count + prior[slot])
        self.lo, self.hi = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        step = (self.hi - self.lo) or 1.0
        quantised = np.rint((value - self.lo) / step * BINS).astype(np.uint16)
        sequences = [EliasFano.build(words >> np.uint64(1), 1 << 63), EliasFano.build(contexts >> np.uint64(1), 1 << 63),
                     EliasFano.build(pointers, len(word) + 1),
                     EliasFano.build(raised, int(tops[-1]) + self.span if len(tops) else 1)]
        levels = MappedLevels([a for s in sequences for a in s.arrays()] + [quantised])
        mapped = iter(levels.arrays)
        self.words, self.contexts, self.pointers, self.pairs = (
            EliasFano(s.n, s.width, next(mapped), next(mapped), next(mapped)) for s in sequences)
        self.values, self.step, self.bytes = next(mapped), step, levels.bytes

    def log_numerators(self, word, before, prior):
        """log10(c(v w) + MU p1(w)) per distinct pair, sorted as in the trie; ``prior`` is MU p1(w)."""
        new_word = _changes(word)
        w = self.words.find(word[new_word] >> np.uint64(1))[np.cumsum(new_word) - 1]
        contexts, place = np.unique(before, return_inverse=True)
        v = self.contexts.find(contexts >> np.uint64(1))[place]
        both = np.flatnonzero((w >= 0) & (v >= 0))
        slots, inverse = np.unique(w[both], return_inverse=True)
        first, last = (self.pointers.access(slots + i).astype(np.int64) for i in (0, 1))
        base = np.where(first > 0, self.pairs.access(np.maximum(first - 1, 0)).astype(np.int64) + 1, 0)
        at = self.pairs.find(base[inverse] + v[both], first[inverse], last[inverse])
        hit = at >= 0
        value = np.log10(prior)
        value[both[hit]] = self.lo + self.values[at[hit]].astype(np.float64) / BINS * self.step
        return value


def _score(shared):
    """Reduce side: one shard's pairs to their values, a row for each map block."""

    def run(table: pa.Table) -> pa.Table:
        head = shared.value
        answered, words, befores, trained, codes = [], [], [], [], []
        own = table.filter(pc.is_valid(table["docs"]))
        table = table.filter(pc.is_null(table["docs"]))
        for payload in table["payload"]:
            counts, code1, code2, tail1, tail2 = _unpack(_PAIRS, payload.as_buffer().to_pybytes())
            w1 = head.hashes[np.minimum(code1, len(head.hashes) - 1)]
            w1[code1 == BEGIN_CODE] = 0
            w1[code1 == TAIL_CODE] = tail1
            w2 = head.hashes[np.minimum(code2, len(head.hashes) - 1)]
            w2[code2 == TAIL_CODE] = tail2
            trained.append(counts), words.append(w2), befores.append(w1), codes.append(code2)
        if words:
            word, before, train, code = (np.concatenate(x) for x in (words, befores, trained, codes))
            order = np.lexsort((before, word))
            new = _changes(word[order], before[order])
            at = np.flatnonzero(new)
            train = np.add.reduceat(train[order].astype(np.int64), at)
            word, before, code = (x[order[at]] for x in (word, before, code))
            seen = train > 0
            is_tail = code == TAIL_CODE
            tails, inverse = np.unique(word[is_tail & seen], return_inverse=True)
            tail_counts = np.bincount(inverse, weights=train[is_tail & seen], minlength=len(tails)).astype(np.int64)
            trie = Trie(word[seen], before[seen], train[seen], head, (tails, tail_counts))
            count = head.counts[np.minimum(code, len(head.counts) - 1)].copy()
            if len(tails):
                at = np.minimum(np.searchsorted(tails, word[is_tail]), len(tails) - 1)
                count[is_tail] = np.where(tails[at] == word[is_tail], tail_counts[at], 0)
            else:
                count[is_tail] = 0
            score = trie.log_numerators(word, before, MU * head.p1(count))
            score[is_tail] -= np.log10(count[is_tail] + MU)
            pair = np.empty(len(order), dtype=np.int64)
            pair[order] = np.cumsum(new) - 1
            for pairs in np.split(pair, np.cumsum([len(x) for x in words])[:-1]):
                tail = np.flatnonzero(is_tail[pairs])
                answered.append(_pack(_ANSWER, score[pairs], tail, count[pairs[tail]]))
        answers = pa.table([table["block"], table["first"], pa.array(answered, pa.binary()), table["docs"]], names=_PARTS)
        return pa.concat_tables([own.select(_PARTS), answers])

    return run


_PARTS = ["block", "first", "payload", "docs"]


def _total(shared):
    """One map block: its documents' own sums and the values of their tokens' pairs."""

    def run(table: pa.Table) -> pa.Table:
        head = shared.value
        mine = table.filter(pc.is_valid(table["docs"]))
        docs = pc.list_flatten(mine["docs"]).combine_chunks()
        own = dict(zip(_OWN, docs.flatten()))
        pair, = _unpack(_TOKENS, mine["payload"][0].as_buffer().to_pybytes())
        values, base, known = (np.zeros(int(pair.max()) + 1) for _ in range(3))
        answers = table.filter(pc.is_null(table["docs"]))
        for first, payload in zip(answers["first"].to_pylist(), answers["payload"]):
            value, tail, count = _unpack(_ANSWER, payload.as_buffer().to_pybytes())
            values[first:first + len(value)] = value
            base[first + tail.astype(np.int64)], known[first + tail.astype(np.int64)] = np.log10(head.p1(count)), count > 0
        starts = np.cumsum(own["n_tokens"].to_numpy()) - own["n_tokens"].to_numpy()  # each text has its end token
        known, base, score = (own[c].to_numpy() + np.add.reduceat(x[pair], starts)
                              for c, x in zip(("n_known", "base", "score"), (known, base, values)))
        return pa.table([own["doc_id"], own["held_out"], own["n_tokens"], pa.array(known.astype(np.int64)),
                         pa.array(np.full(len(docs), head.n)), pa.array(base), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text, held_out)."""
    spark = docs.sparkSession
    counts = materialize(docs.mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "words")
    # words by count: at most sqrt(2 N) different counts
    by_count = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    n, v = sum(c * k for c, k in by_count), sum(k for _, k in by_count)
    least, words = 1 << 62, 0
    for c, k in by_count:
        if words + k > HEAD:
            break
        least, words = c, words + k
    end = int(END.view(np.int64))
    top = counts.filter((F.col("c") >= least) | (F.col("h") == end)).toPandas()  # at most HEAD + 1 words
    hashes, freq = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    if END not in hashes:
        hashes, freq = np.append(hashes, END), np.append(freq, 0)
    head = spark.sparkContext.broadcast(Head(hashes, freq, n, v))
    tokens = n * 10 // 9
    shards = max(MIN_SHARDS, -(-tokens // SHARD_TOKENS))
    posted = docs.mapInArrow(_posting(head, shards), _POSTED)
    partial = posted.groupBy("shard").applyInArrow(_score(head), _PARTIAL)
    return partial.groupBy("block").applyInArrow(_total(head), _SCORED)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 10, 0).alias("held_out")))
