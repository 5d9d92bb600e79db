"""Benchmark decontamination.

Benchmark items become windows of 13 normalised words (an item of fewer words
is one window).  Items are dealt to groups of at most about ``GROUP_BYTES`` of
text; each group becomes sorted window hashes plus the items' words, and is
broadcast: its size is bounded by that parameter.  A scan rolls window hashes over
each whole document, looks them up in the hash set, and verifies every hit word by
word against the distinct windows of that hash, each with its list of items.

One group needs one map step and no shuffle.  A larger benchmark saves the documents
once with a row key; each group then is a pass of its own over the saved texts that
writes only the rows it hits (key, word ranges, items), so a task holds one group at a
time, however many there are, and the hits go back by one join on the key.

Defined cases: a null or empty document has no words, no hits and is clean; an
item without words has no window; a null item_id counts as ''; repeated items
and rows count as they are; empty tables give no hits or no rows; further
columns pass through ``scan`` unchanged (its own are prefixed ``decon_``; with more
than one group they are of types that Parquet holds).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import materialize
from .blocks import ALNUM, Block, LOWER, blocks

WINDOW = 13
GROUP_BYTES = 8 << 20
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Index:
    """Window hashes of a group of items and what is needed to verify them."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids = [i for i, _ in items]
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        block = Block(data, np.cumsum([0] + [len(t) for _, t in items])).words(ALNUM)
        self.text = LOWER[data].tobytes()
        self.starts, self.ends = block.starts, block.ends
        n = np.diff(block.first)
        parts = []
        for size in sorted(set(np.minimum(n[n > 0], WINDOW).tolist())):
            row, at, hashes = block.windows(size)
            use = (n[row] >= WINDOW) if size == WINDOW else (n[row] == size)
            parts.append((hashes[use], row[use], at[use], np.full(use.sum(), size)))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        order = np.argsort(cols[0], kind="stable")
        self.hashes, self.row, self.at, self.size = (c[order] for c in cols)
        self.sizes = sorted(set(self.size.tolist()))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def windows(self, a: int, b: int) -> dict[tuple, set]:
        """The distinct windows (words) among entries ``a`` to ``b``, each with its items."""
        out: dict[tuple, set] = {}
        for j in range(a, b):
            at, size = self.at[j], self.size[j]
            words = tuple(self.text[s:e] for s, e in zip(self.starts[at:at + size], self.ends[at:at + size]))
            out.setdefault(words, set()).add(self.ids[self.row[j]])
        return out


def _merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _find(index: Index, block: Block):
    """Per row: verified word ranges and item ids."""
    spans, items = {}, {}
    known: dict[int, dict] = {}
    for size in index.sizes:
        row, at, hashes = block.windows(size)
        cand = np.flatnonzero(index.filter[hashes >> np.uint64(44)])
        lo = np.searchsorted(index.hashes, hashes[cand], "left")
        hi = np.searchsorted(index.hashes, hashes[cand], "right")
        for c, a, b in zip(cand[hi > lo], lo[hi > lo], hi[hi > lo]):
            if a not in known:
                known[a] = index.windows(a, b)
            w = at[c]
            own = tuple(LOWER[block.data[s:e]].tobytes() for s, e in zip(block.starts[w:w + size], block.ends[w:w + size]))
            hit = known[a].get(own)
            if hit:
                r, first = row[c], w - block.first[row[c]]
                spans.setdefault(r, []).append((int(first), int(first) + size))
                items.setdefault(r, set()).update(hit)
    return {r: _merge(s) for r, s in spans.items()}, items


_FOUND = [T.StructField("decon_spans", T.ArrayType(T.StructType([
              T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
          T.StructField("decon_items", T.ArrayType(T.StringType()))]


def _found(rows, spans, items):
    """Columns of word ranges and items of the rows numbered ``rows``."""
    return [pa.array([[{"start": a, "end": b} for a, b in spans.get(r, ())] for r in rows], _SPANS),
            pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string()))]


def _one_pass(docs: DataFrame, text_col: str, index) -> DataFrame:
    """``docs`` with the words counted and the hits of the one group."""
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, text_col):
                block.words(ALNUM)
                cols = [*rows.columns, pa.array(np.diff(block.first), pa.int64()), *_found(range(len(block)), *_find(index.value, block))]
                yield pa.RecordBatch.from_arrays(cols, names=[*rows.schema.names, "decon_n_words", "decon_spans", "decon_items"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("decon_n_words", T.LongType()), *_FOUND]))


def _hits(texts: DataFrame, text_col: str, index) -> DataFrame:
    """(key, word ranges, items) of the rows of (key, text) that a group hits."""
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, text_col):
                block.words(ALNUM)
                spans, items = _find(index.value, block)
                hit = sorted(spans)
                if hit:
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(hit, pa.int64())), *_found(hit, spans, items)],
                                                     names=["decon_key", "decon_spans", "decon_items"])

    return texts.mapInArrow(run, T.StructType([T.StructField("decon_key", T.LongType()), *_FOUND]))


def _joined_hits(parts: DataFrame) -> DataFrame:
    """One row a key: ranges merged, items sorted.  A key has at most a row a group."""
    def run(batches):
        for batch in batches:
            spans = [_merge([s["start"], s["end"]] for s in row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_found(range(len(spans)), dict(enumerate(spans)),
                                                                       dict(enumerate(map(set, batch.column(2).to_pylist()))))],
                                             names=["decon_key", "decon_spans", "decon_items"])

    grouped = parts.groupBy("decon_key").agg(F.flatten(F.collect_list("decon_spans")).alias("decon_spans"),
                                             F.flatten(F.collect_list("decon_items")).alias("decon_items"))
    return grouped.mapInArrow(run, T.StructType([T.StructField("decon_key", T.LongType()), *_FOUND]))


def _count_words(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, text_col):
                cols = [*rows.columns, pa.array(np.diff(block.words(ALNUM).first), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*rows.schema.names, "decon_n_words"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("decon_n_words", T.LongType())]))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``decon_n_words``, ``decon_spans`` (hit word ranges) and ``decon_items``."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))

    def index(part):  # <= about group_bytes
        return spark.sparkContext.broadcast(Index([(r["id"], r["t"].encode()) for r in part.distinct().collect()]))

    if groups == 1:
        return _one_pass(docs, text_col, index(bench))
    saved = materialize(_count_words(docs, text_col).withColumn("decon_key", F.monotonically_increasing_id()), "decon-docs")
    texts, parts = saved.select("decon_key", text_col), None
    for g in range(groups):
        held = index(bench.filter(F.pmod(F.xxhash64("id", "t"), F.lit(groups)) == g))
        part = materialize(_hits(texts, text_col, held), "decon-hits")
        held.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    found = materialize(_joined_hits(parts), "decon-found")
    return saved.join(found, "decon_key", "left").withColumns({
        f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in _FOUND}).drop("decon_key")


def n_hit():
    return F.aggregate("decon_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated():
    """A document with hits in at least 5 % of its words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("decon_n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents",
                  text_col: str = "text", **params) -> DataFrame:
    """Same columns: ``documents`` drops contaminated documents, ``spans`` cuts hit word ranges
    (from the first hit word's start to the last one's end) out of every text."""
    scanned = scan(docs, benchmark, text_col, **params)
    if mode == "documents":
        return scanned.filter(~contaminated()).select(*docs.columns)
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")

    names = docs.columns

    def cut(batches):
        for batch in batches:
            for rows, block in blocks(batch, text_col):
                block.words(ALNUM)
                i = rows.schema.get_field_index(text_col)
                texts = rows.column(i).to_pylist()
                for r, spans in enumerate(rows.column(rows.schema.get_field_index("decon_spans")).to_pylist()):
                    if spans:
                        raw, base, at, kept = block.text(r), block.offsets[r], 0, []
                        for s in spans:
                            kept.append(raw[at:block.starts[block.first[r] + s["start"]] - base])
                            at = block.ends[block.first[r] + s["end"] - 1] - base
                        texts[r] = b"".join([*kept, raw[at:]]).decode()
                cols = [pa.array(texts, rows.column(i).type) if k == i else rows.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return scanned.mapInArrow(cut, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.col("decon_n_words").alias("n_words"), n_hit().alias("n_hit"),
                      F.size("decon_items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("decon_items"), ","), 256).alias("items_sha256"),
                      contaminated().alias("contaminated"))


OP1_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: ws[i:i+12])) AS g FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(g) AS l FROM win),
dw AS (SELECT doc_id, l, i, ws[i:i+l-1] AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM low, sizes)),
hits AS (SELECT dw.doc_id, dw.l, dw.i, win.item FROM dw JOIN win ON dw.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.list, '')) AS items_sha256, coalesce(w.n, 0) > 0 AND 20 * coalesce(w.n, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN words w USING (doc_id) LEFT JOIN items t USING (doc_id)"""
