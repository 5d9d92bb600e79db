"""Token-id files: range asymmetric numeral system blocks in ascending id order.

1. Each whole text is tokenised; packed ids (end id appended) are written once.
2. Id counts over all documents give one shared frequency table (bounded by
   the vocabulary, so it is broadcast and stored as ``table``).
3. Rows are dealt by doc_id range and sorted; each task packs consecutive
   documents into blocks of about ``BLOCK_TOKENS`` ids (a longer document has
   a block of its own) and writes them to ``blocks``: one row per block with
   documents, ids before it in its part, payload and crc32.
4. Reading decodes blocks independently, verifies checksums, and adds the
   part's offset (one total per part).

Defined cases: a null or empty text is the end id alone; a null doc_id sorts
first; repeated rows are encoded each; an empty table gives no blocks and no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import shared_folder
from . import rans
from .blocks import blocks

BLOCK_TOKENS = 1 << 18
END_ID = 0
BLOCK_SCHEMA = ("part int, seq int, before bigint, n_tokens bigint, doc_ids array<bigint>, "
                "doc_tokens array<bigint>, payload binary, crc bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_width(tokenizer: str) -> int:
    """Bytes that hold every id of the vocabulary."""
    from .tokens import _tokenizer

    return 2 if _tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else 4


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): packed ids with the end id, of ``id_width`` bytes each, little-endian."""
    width = id_width(tokenizer)

    def run(batches):
        from .tokens import Encoder

        encoder = Encoder(tokenizer)
        for batch in batches:
            for rows, block in blocks(batch, "text", 1 << 20):
                ids, offsets = encoder.encode(block)
                ends = np.insert(ids, offsets[1:], END_ID).astype(f"<u{width}")
                cuts = offsets + np.arange(len(offsets))
                packed = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(ends)])
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), packed], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def _counter(width: int):
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, block in blocks(batch, "ids", 4 << 20):
                own = np.bincount(np.frombuffer(block.data.tobytes(), f"<u{width}"))
                if len(own) > len(total):
                    own[:len(total)] += total
                    total = own
                else:
                    total[:len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return run


def _packer(table, width: int):
    def run(batches):
        context = TaskContext.get()
        part, seq, before = context.partitionId() if context else 0, 0, 0
        held_ids, held_docs = [], []
        columns = [[] for _ in range(8)]

        def flush():
            nonlocal seq, before
            ids = np.concatenate(held_ids)
            row = (part, seq, before, len(ids), held_docs[:], [len(x) for x in held_ids],
                   rans.encode(ids, table.value), rans.checksum(ids))
            for c, v in zip(columns, row):
                c.append(v)
            seq, before = seq + 1, before + len(ids)
            held_ids.clear(), held_docs.clear()

        def ready():
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            names = ["part", "seq", "before", "n_tokens", "doc_ids", "doc_tokens", "payload", "crc"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            for c in columns:
                c.clear()
            return out

        held = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                if held and held + len(ids) > BLOCK_TOKENS:
                    flush()
                    held = 0
                held_ids.append(ids.astype("<u4"))
                held_docs.append(doc)
                held += len(ids)
                if len(columns[0]) >= 8:
                    yield ready()
        if held_ids:
            flush()
        if columns[0]:
            yield ready()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as token files under ``path`` (a folder that all executors share)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    width = id_width(tokenizer)
    tokenise(docs, tokenizer, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    counts = ids.select("ids").mapInArrow(_counter(width), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    # rows of one doc_id, or of none, are dealt apart by their ids, equal rows by their place
    place = ids.withColumn("ids_hash", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "ids_hash", "place"]
    ordered = place.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(_packer(_table(spark, path), width), BLOCK_SCHEMA).write.option(
        "compression", "none").parquet(f"{path}/blocks")


def _table(spark, path: str):
    rows = spark.read.parquet(f"{path}/table").toPandas()  # at most one row per id of the vocabulary
    return spark.sparkContext.broadcast(rans.Table(rows["id"].to_numpy(), rows["n"].to_numpy()))


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) of each document, decoded from the blocks."""
    table = _table(spark, path)
    packed = spark.read.parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, at = {}, 0
    for part in sorted(totals):  # one number per part
        offsets[part] = at
        at += totals[part]
    offsets = spark.sparkContext.broadcast(offsets)

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids = rans.decode(col["payload"][i].as_py(), table.value)
                if rans.checksum(ids) != col["crc"][i].as_py():
                    raise ValueError("checksum mismatch in a token block")
                sizes = np.array(col["doc_tokens"][i].as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                first = offsets.value[col["part"][i].as_py()] + col["before"][i].as_py()
                raw = ids.astype("<u4")
                cols = [pa.array(col["doc_ids"][i].as_py(), pa.int64()), pa.array(first + ends - sizes), pa.array(sizes),
                        pa.array([zlib.crc32(raw[e - n:e]) for e, n in zip(ends, sizes)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([raw[e - n:e].tolist() for e, n in zip(ends, sizes)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return packed.select("part", "before", "doc_ids", "doc_tokens", "payload", "crc").mapInArrow(run, kind)


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = shared_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)


def op8(spark, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
