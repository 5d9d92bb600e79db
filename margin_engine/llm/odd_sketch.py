"""Near-duplicates by odd sketches of MinHash samples, with banded candidates.

1. One scan turns each whole text into its set of 5-word shingles (64-bit
   hashes), a 128-bit set signature, ``ROWS * BANDS`` MinHash values cut into
   bands, and an odd sketch: every (k, minimum) flips one of ``BITS`` parity bits,
   so the XOR of two sketches counts the samples in which two sets differ.  A
   second odd sketch folds the shingles themselves into ``SET_BITS`` parity bits:
   its XOR count never exceeds the number of shingles that only one set has.
2. Equal sets collapse to their smallest doc_id (partial aggregation).
3. Representatives that share a band are candidates.  At similarity 0.75 a
   pair shares no band with probability (1 - 0.75^4)^48 = 1e-8.
   Round 1 tests each against its most similar bucket minimum (by sketch).
   Round 2 compares, in every bucket that still spans several components, the
   members outside the bucket's largest component with all members of other
   components and near sizes; only pairs that sizes and sketches allow leave
   the join and are confirmed.
   The test on MinHash samples keeps six standard deviations: it only drops
   pairs whose XOR count shows a similarity under about 0.44.  The test on
   shingles is a bound and drops no link: at similarity 0.75 or more at most a
   seventh of both sizes' sum differs; it tells 0.70 from 0.75 in sets of up to
   some 400 shingles and loosens towards 0.6 at 1,000.
4. Every link is confirmed on the full shingle sets, and components follow by
   star contraction.  No bucket is gathered in one task; joins on hot
   bands are split by the adaptive skew join.

Defined cases: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of fewer than five words has its whole word
sequence as its one shingle; a null doc_id is never linked and is kept;
repeated rows of a doc_id are one node (``dedup`` keeps one of them); an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import SPACED, blocks, mix, ranges_hash
from .components import components

SHINGLE = 5
BANDS, ROWS = 48, 4
BITS = 512
SET_BITS = 1024
_K = BANDS * ROWS
_FLIP = mix(np.arange(1, _K + 1, dtype=np.uint64))
_TIMES = mix(np.arange(1001, 1001 + _K, dtype=np.uint64)) | np.uint64(1)
#: Largest XOR count of two sketches that similarity 0.75 gives within six deviations.
MAX_XOR = 146
NUM, DEN = 3, 4
PAIR_BYTES = 2 << 20

SIGNED = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>"


def shingle_sets(block):
    """(values, offsets): sorted distinct shingle hashes of each row."""
    block.words(SPACED)
    row, _, hashes = block.windows(SHINGLE)
    n = np.diff(block.first)
    ends = np.cumsum(np.maximum(n - SHINGLE + 1, 0))
    few = (n > 0) & (n < SHINGLE)
    whole = ranges_hash(block.word_sums(), block.first[:-1], block.first[1:])
    sets = []
    for i in range(len(block)):
        if few[i]:
            sets.append(whole[i:i + 1])
        else:
            sets.append(np.unique(hashes[ends[i - 1] if i else 0:ends[i]]))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(K, rows) minima; rows must not be empty."""
    out = np.empty((_K, len(offsets) - 1), dtype=np.uint64)
    buffer = np.empty_like(values)
    for k in range(_K):
        np.bitwise_xor(values, _FLIP[k], out=buffer)
        np.multiply(buffer, _TIMES[k], out=buffer)
        np.minimum.reduceat(buffer, offsets[:-1], out=out[k])
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(rows, BITS // 64) parity bitmaps of the samples."""
    bit = mix(mins + np.arange(_K, dtype=np.uint64)[:, None]) % np.uint64(BITS)
    out = np.zeros((mins.shape[1], BITS // 64), dtype=np.uint64)
    at = np.arange(mins.shape[1])
    for k in range(_K):
        out[at, (bit[k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[k] & np.uint64(63))
    return out


def set_sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, SET_BITS // 64) parity bitmaps of the sets."""
    wide = SET_BITS // 64
    out = np.zeros((len(offsets) - 1) * wide, dtype=np.uint64)
    bit = mix(values ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SET_BITS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_xor.at(out, row * wide + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(-1, wide)


def _sign(batches):
    for batch in batches:
        for rows, block in blocks(batch, "text"):
            values, offsets = shingle_sets(block)
            sizes = np.diff(offsets)
            has = np.flatnonzero(sizes)
            sig = np.zeros((2, len(sizes)), dtype=np.uint64)
            bands = np.zeros((len(sizes), BANDS), dtype=np.uint64)
            sketch = np.zeros((len(sizes), BITS // 64), dtype=np.uint64)
            if len(has):
                cuts = offsets[:-1][has]
                sig[0, has] = np.add.reduceat(values, cuts)
                sig[1, has] = np.add.reduceat(mix(values ^ np.uint64(0x5BD1E995)), cuts)
                mins = minhashes(values, np.append(cuts, len(values)))
                sketch[has] = odd_sketches(mins)
                for b in range(BANDS):
                    key = np.full(len(has), b + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[b * ROWS + r])
                    bands[has, b] = key
            parity = set_sketches(values, offsets)
            lists = lambda m: pa.ListArray.from_arrays(
                np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array(sizes), pa.array(sig[0].view(np.int64)),
                 pa.array(sig[1].view(np.int64)), lists(bands), lists(sketch), lists(parity)],
                names=["doc_id", "n_shingles", "sig1", "sig2", "bands", "sketch", "parity"])


def _confirm(batches):
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy().astype(np.int64) for i in (2, 3))
        part = np.cumsum(sizes) // PAIR_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            rows = batch.slice(lo, hi - lo)
            (va, oa), (vb, ob) = (shingle_sets(block) for name in ("text_a", "text_b") for _, block in blocks(rows, name, 1 << 62))
            keep = []
            for i in range(len(rows)):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sign, SIGNED)


def _xor(a, b, bits):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)), F.lit(0))


def _allowed():
    """What set sizes (n_u, n_v), sketches (s_u, s_v) and parities (p_u, p_v) of a pair allow."""
    return ((DEN * F.least("n_u", "n_v") >= NUM * F.greatest("n_u", "n_v"))
            & (_xor("s_u", "s_v", BITS) <= MAX_XOR)
            & ((DEN + NUM) * _xor("p_u", "p_v", SET_BITS) <= (DEN - NUM) * (F.col("n_u") + F.col("n_v"))))


def _similar(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (u, v) that sketches and set sizes allow, with their XOR count."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"),
                                F.col("parity").alias(f"p_{c}"))
    return (pairs.join(side("u"), "u").join(side("v"), "v").filter(_allowed())
            .withColumn("xor", _xor("s_u", "s_v", BITS)).select("u", "v", "xor"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: texts.select(F.col("doc_id").alias(c[0]), F.col("text").alias(c[1]))
    return materialize(pairs.join(side(("u", "text_a")), "u").join(side(("v", "text_b")), "v")
                       .select("u", "v", "text_a", "text_b").mapInArrow(_confirm, "u bigint, v bigint"), "links")


def open_pairs(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components and near sizes that share a bucket, with what ``_allowed`` reads.

    ``u`` is always outside the bucket's largest component, so the join meets (rows outside it) x (rows)
    and never pairs that component's own members, however many it has."""
    labelled = members.join(found, F.col("rep") == F.col("node"), "left").select(
        "band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    # sets of similarity 0.75 differ by one size class at most
    open_ = materialize(labelled.join(mixed.drop("roots"), "band").join(sketches, "rep").withColumn(
        "class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))), "open")
    side = lambda c: [F.col("rep").alias(c), *(F.col(x).alias(f"{y}_{c}") for x, y in (
        ("root", "root"), ("n", "n"), ("sketch", "s"), ("parity", "p")))]
    near = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])).alias("class")
    u = open_.filter("root <> main").select("band", *side("u"), near)
    v = open_.select("band", *side("v"), "class", (F.col("root") == F.col("main")).alias("in_main"))
    # two outside rows meet once, a row of the largest component meets every outside row
    return u.join(v, (u["band"] == v["band"]) & (u["class"] == v["class"]) & (F.col("root_u") != F.col("root_v"))
                  & (F.col("in_main") | (F.col("u") > F.col("v"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``."""
    signed = materialize(sign(docs, id_col, text_col), "signatures")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = materialize(
        sets.groupBy("sig1", "sig2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sketch", "parity"), "doc_id").alias("x"))
        .select("rep", F.col("n_shingles").alias("n"), "sig1", "sig2", "x.bands", "x.sketch", "x.parity"), "representatives")
    keys = reps.select("rep", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = materialize(keys.join(shared.drop("m"), "band"), "buckets")  # (band, rep, first)
    sketches = reps.select("rep", "n", "sketch", "parity")

    # the texts that any confirmation can need: of representatives that share a band
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .join(ids, "doc_id").dropDuplicates(["doc_id"]), "texts")

    stars = _similar(members.filter("rep <> first").select(
        F.col("rep").alias("u"), F.col("first").alias("v")).distinct(), sketches)
    best = stars.groupBy("u").agg(F.min(F.struct("xor", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
    links = _verified(best, texts)
    found = components(links)

    cross = open_pairs(members, found, sketches).filter(_allowed()).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    more = _verified(cross.join(best, ["u", "v"], "left_anti"), texts)
    if more.limit(1).count():
        found = components(links.union(more))
    found = materialize(found, "components")

    member_of = reps.select("rep", "sig1", "sig2", F.col("n").alias("n_shingles")).join(
        found, F.col("rep") == F.col("node"), "left").select(
        "sig1", "sig2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    return signed.select("doc_id", "n_shingles", "sig1", "sig2").join(
        member_of, ["sig1", "sig2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(
            F.col("doc_id")).alias("component_id")).withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component (its smallest doc_id), same columns."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).cast("bigint").alias("own_id"))
    rows = rows.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti")
    # a row without id is a group of its own, so no task gathers them
    key = F.struct(F.col("own_id"), F.when(F.col("own_id").isNull(), F.monotonically_increasing_id()))
    n = F.row_number().over(Window.partitionBy("own_key").orderBy(F.col("whole").getField(text_col)))
    kept = rows.withColumn("own_key", key).withColumn("n", n).filter("n = 1")
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * same >= 75 * (x.n + y.n - same)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id AND r.root < e.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id,
  coalesce(min(r.root), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""
