"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features of a text: word unigrams and bigrams, n-grams (1 to 3) of word shapes
(letters to a / A, digits to 0, runs collapsed), and whether a word repeats the
previous one, all hashed to ``DIMS`` slots; a slot's value is its count over the
number of words, times ``SCALE``.  Training takes a bounded sample of labelled rows
(``TRAIN_ROWS``, by hash of the id, whole texts) in one task; the weights
(at most ``DIMS`` numbers) are broadcast and every whole text is scored as a
sparse dot product.

Defined cases: a null or empty text has no features (its score is the bias's);
null labels and labels of unknown documents are ignored; repeated labels
train once; without labels every score is 0.5; a null doc_id is scored and not held
out; repeated rows are scored each; further columns, of any name, are ignored.  Training
goes by the hash of the id, ties by label and features, so it does not depend on the
order in which rows arrive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _BYTES, SPACED, Block, blocks, mix, prefix_sums, ranges_hash

DIMS = 1 << 18
TRAIN_ROWS = 8000
EPOCHS = 4
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[0x80:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(block: Block):
    """(slots, offsets): hashed n-gram occurrences of each row, in no special order inside it."""
    block.words(SPACED, lower=False)
    n = np.diff(block.first)
    shape = _SHAPE[block.data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[block.starts] = True
    index = np.concatenate([[0], np.cumsum(keep)])
    shapes = ranges_hash(prefix_sums(_BYTES[shape[keep]]), index[block.starts], index[block.ends])
    shape_sums, word_sums = prefix_sums(shapes), block.word_sums()
    same = np.zeros(len(block.starts), dtype=np.uint64)
    same[1:] = block.hashes[1:] == block.hashes[:-1]
    same[block.first[:-1][n > 0]] = 0
    rows, slots = [], []
    every = np.repeat(np.arange(len(block)), n)
    for tag, (sums, size) in enumerate([(word_sums, 1), (word_sums, 2), (shape_sums, 1), (shape_sums, 2), (shape_sums, 3)]):
        per = np.maximum(n - size + 1, 0)
        row = np.repeat(np.arange(len(block)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + block.first[row]
        rows.append(row)
        slots.append(mix(ranges_hash(sums, at, at + size) + np.uint64(tag)) >> np.uint64(46))
    rows.append(every)
    slots.append(mix(same + np.uint64(99)) >> np.uint64(46))
    row, slot = np.concatenate(rows), np.concatenate(slots).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return slot[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))]), n


def train(examples, dims: int = DIMS, epochs: int = EPOCHS):
    """FTRL-proximal over (slots, values, label) examples: (weights, bias)."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for slots, values, label in examples:
            w = weights(slots)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - sigma * w
            n[slots] += g * g
    every = weights(np.arange(dims + 1))
    return every[:dims], float(every[dims])


def _train(batches):
    examples = []
    for batch in batches:
        for rows, block in blocks(batch, "text"):
            slots, offsets, n = features(block)
            keys, labels = rows.column(0).to_pylist(), rows.column(2).to_pylist()
            for i in range(len(block)):
                ids, count = np.unique(slots[offsets[i]:offsets[i + 1]], return_counts=True)
                examples.append((keys[i], np.append(ids, DIMS).astype(np.int32),
                                 np.append(count * (SCALE / max(1, n[i])), 1.0).astype(np.float32), labels[i]))
    examples.sort(key=lambda e: (e[0], e[3], e[1].tobytes(), e[2].tobytes()))
    w, bias = train([e[1:] for e in examples])
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, DIMS), pa.int32()), pa.array(np.append(w[used], bias))], names=["slot", "w"])


def fit(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS):
    """Weights from ``labelled`` (doc_id, label): about ``rows`` of them by hash of the id."""
    labelled = labelled.select("doc_id", "label").filter("label is not null and doc_id is not null").distinct()
    total = labelled.count()
    share = min(1.0, rows / max(1, total))
    cut = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = labelled.withColumn("order", cut).filter(F.col("order") < int(share * (1 << 30)))
    # the sample's ids are bounded by the parameter, so they are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("order", "text", "label")
    got = texts.repartition(1).mapInArrow(_train, "slot int, w double").toPandas()
    w = np.zeros(DIMS + 1)
    w[got["slot"].to_numpy()] = got["w"].to_numpy()
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value
        for batch in batches:
            for rows, block in blocks(batch, "text", 512 << 10):
                slots, offsets, n = features(block)
                sums = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
                x = (sums[offsets[1:]] - sums[offsets[:-1]]) * (SCALE / np.maximum(n, 1)) + w[DIMS]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def held_out(key, mod: int, rest: int):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == rest, F.lit(False))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = fit(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    return score(docs, weights).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                                       (F.col("score") >= 0.7).cast("int").alias("predicted"))
