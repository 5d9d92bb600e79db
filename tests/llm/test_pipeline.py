"""The corpus pipeline as a whole against a brute-force version in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from margin_engine.llm import mixing, quality_rules, token_files

from .test_operators import SF, brute_components, low

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(rows):
    def measures(text):
        w, text = spaced(text), text or ""
        chars = sum(map(len, w))
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if spaced(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        return failed, {"symbol_pm": 1000 * len(re.findall(r"[#*$%&|<>]", text)) // max(chars, 1),
                        "dup_line_pm": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1),
                        "repeat_pm": 1000 * len(cover) // max(len(w), 1), "word_len_x100": 100 * chars // max(len(w), 1),
                        "shout_pm": 1000 * len(re.findall("[A-Z!]", text)) // max(chars, 1)}

    def binned(v):
        step = 1
        while v >= 200 * step and v >= 200:
            step *= 10
        return v - v % step

    measured = [(r, *measures(r[1])) for r in rows]
    held = collections.defaultdict(list)
    for r, _, m in measured:
        for k, v in m.items():
            for group in ((r[2], r[3]), (r[2],), ()):
                held[group, k].append(binned(v))

    def limit(r, k):
        for group in ((r[2], r[3]), (r[2],), ()):
            bins = sorted(held[group, k])
            if len(bins) >= quality_rules.MIN_DOCS:
                q1, q3 = (bins[-(-q * len(bins) // 4) - 1] for q in (1, 3))
                return q3 + 3 * max(q3 - q1, quality_rules.FLOORS[k])
        return math.inf

    return [r for r, failed, m in measured if not failed and all(v <= limit(r, k) for k, v in m.items())]


def near_duplicates(rows):
    _, root = brute_components(rows)
    first = {}
    for r in rows:
        if r[0] is not None and root[r[0]] == r[0]:
            first[r[0]] = min(first.get(r[0], r), r, key=lambda x: x[1] or "")
    return list(first.values()) + [r for r in rows if r[0] is None]


def decontaminate(rows, bench):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for _, text in bench:
        w = find(text)
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(g) for g in windows}

    def clean(text):
        w = find(text)
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows for p in range(i, i + n)}
        return not hit or 20 * len(hit) < len(w)

    return [r for r in rows if clean(r[1])]


def mix(rows):
    size, docs, plans = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r[3]] += len(spaced(r[1]))
        docs[r[3]] += 1
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, target = 150 * sum(size.values()), set(order), {}
    while free:
        weights = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left > 200 * size[s] * weights}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: weight[s] * left / (100 * weights) for s in free}
        left -= sum(200 * size[s] for s in over)
        free = free - over if over else set()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    cells = collections.defaultdict(list)
    for r in rows:
        i, s, tie = r[0], r[3], md5(r[1] or "")
        h = md5(f"{mixing.SEED}:{tie if i is None else i}")
        cells[s, int(h[:7], 16) % max(1, -(-docs[s] // mixing.CELL))].append((len(spaced(r[1])), h, i, tie))
    for (s, cell), members in cells.items():
        rate = target[s] / size[s] if size[s] else 0.0
        frac, start = rate - math.floor(rate), int(md5(f"{mixing.SEED}:{s or ''}:{cell}")[:5], 16) / (1 << 20)
        for k, (_, _, i, tie) in enumerate(sorted(members)):
            plans[i, s, tie] = plans.get((i, s, tie), 0) + math.floor(rate) + math.floor((k + 1) * frac + start) - math.floor(k * frac + start)
    one = {(r[0], r[3], md5(r[1] or "")): r for r in rows}
    return [one[key] for key, n in plans.items() for _ in range(n)]


def encode(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        yield r[0], len(ids), zlib.crc32(ids.tobytes())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long_ = [r for r in rows if len(spaced(r[1])) > 60][:12]
    bench = [(f"b{k}", " ".join(spaced(r[1])[:40])) for k, r in enumerate(long_[:3])] + [("short", "zeta alpha"), (None, None)]
    extra = [(90_001, None), (90_002, ""), (90_003, "too short"), (90_004, "same words " * 300), (90_005, long_[5][1]),
             (90_006, long_[6][1] + " one more tail"), (90_007, "##$$%% " * 40 + long_[7][1]),
             (90_008, long_[8][1] + " " + " ".join(spaced(long_[0][1])[:40])), (90_009, long_[9][1].upper()), (None, long_[10][1][::-1])]
    rows += [(i, t, None if k % 2 else "en", None if k % 3 else "src0", 0) for k, (i, t) in enumerate(extra)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_pipeline(spark, tables):
    folder, rows, bench = tables
    a = quality(rows)
    b = near_duplicates(a)
    c = decontaminate(b, bench)
    d = mix(c)
    assert len(rows) > len(a) > len(b) > len(c) > 0  # every filtering stage has something to do
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert collections.Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == collections.Counter(encode(d))
    at = 0
    for g in got:
        assert g.start == at
        at += g.n_tokens
    ids = [(g.doc_id is not None, g.doc_id or 0) for g in got]
    assert ids == sorted(ids)


def test_stages_keep_columns_of_any_name(spark, tables):
    folder, rows, _ = tables
    names = ("kept", "base_failed", "quality_m", "mix_copies", "dedup_row", "size", "row")
    docs = spark.createDataFrame([(*r, *[f"{c}-{r[0]}" for c in names]) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}-{r.doc_id}" for c in names), name


def test_repeated_rows_and_rows_without_id_meet_the_target(spark):
    texts = [f"t{i} " + "w " * (i % 7) for i in range(60)]
    rows = [(None, texts[i % 60], "en", "a", 0) for i in range(1200)] + [(5, "same five words are here", "en", "b", 0)] * 900
    rows += [(i, "one two three", "en", "c", 0) for i in range(100, 700)] + [(None, None, None, None, None)] * 10
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.source: r.target for r in mixing.targets(docs.select("source", mixing.text_size(F.col("text")).alias("size"))).collect()}
    mixed = mixing.mix(docs)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()}
    for s, target in want.items():
        assert abs(got.get(s, 0) - target) <= 16, (s, got.get(s), target)  # about one document a cell
    most = mixed.groupBy("source", "text").count().collect()
    held = collections.Counter((r[3], r[1]) for r in rows)
    assert all(r["count"] <= 2 * held[r.source, r.text] for r in most)
    assert mixed.exceptAll(mixing.mix(docs.repartition(7))).count() == 0


def test_stage_columns_and_empty_tables(spark, tables):
    folder, rows, _ = tables
    docs = spark.createDataFrame([], SCHEMA + ", kept string, size string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
