"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
docs.  Every stage but the last returns the columns of ``documents``.

Defined cases, stage by stage: columns of any name are carried (a column ``kept`` or ``size`` too).  Quality rules: null
and empty texts have no words and go.  Near-duplicates: repeated rows of a doc_id leave one; rows without doc_id all stay.
Decontamination: null texts stay.  Mixing: every row, repeated ones and those without doc_id too, has its own rank; a null source is
a source.  Token files: a null text is the end id alone, a null doc_id sorts first.  Empty tables give empty results.
"""

from __future__ import annotations

from margin_engine.llm import decontaminate, mixing, odd_sketch, quality_rules, token_files
from margin_engine.plans.materialize import shared_folder


def quality(spark, docs, sf_dir):
    """Operator 10: documents that the base rule or an adaptive threshold rejects go."""
    return quality_rules.keep(docs)


def near_dedup(spark, docs, sf_dir):
    """Operator 9: the smallest doc_id of each near-duplicate component stays."""
    return odd_sketch.dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Operator 1: documents with benchmark passages in 5 % of their words go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    """Operator 7: each source is repeated or sampled to its target."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """Operator 8: token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.write_and_read(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontamination),
          ("mixing", mixture), ("token files", encode)]

#: None: byte-pair encoding cannot be expressed in SQL (tests hold each stage against brute force).
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to ``documents``; each result is written to the shared checkpoint folder."""
    base = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
