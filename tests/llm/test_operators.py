"""The ten operators against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import json
import math
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from margin_engine.llm import (components, decontaminate, mixing, ngram_lm, odd_sketch, pii, quality_model,
                               quality_rules, rans, suffix_dedup, token_files, tool_calls)
from margin_engine.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, copies string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def rows(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    extra = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "ONE two"), (9005, "one TWO"), (9006, "x" * 5000),
             (9007, "a b c d e f g h i j k l m n " * 300), (9008, base[0][1]), (9008, base[0][1]), (None, "no id here at all"),
             (9009, "é 中文 ünïcode " * 40)]
    return base + [(i, t, None if i is None or i % 2 else "en", None if i is None or i % 3 else "src0", 0) for i, t in extra]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + ("clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontaminate(spark, docs, rows, empty):
    bench = [("b1", " ".join(words(rows[3][1])[:40])), ("b2", "one two"), (None, None), ("b3", "")]
    table = spark.createDataFrame(bench, "item_id string, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for item, text in bench:
        w = find(text)
        for i in range(max(0, len(w) - 12) if len(w) >= 13 else bool(w)):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(item or "")
    for group_bytes in (1 << 20, 60):
        got = decontaminate.scan(docs, table, group_bytes=group_bytes).collect()
        want = collections.Counter()
        for r in rows:
            w, hit, items = find(r[1]), set(), set()
            for g, own in windows.items():
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i:i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        items |= own
            want[(r[0], len(w), len(hit), tuple(sorted(items)))] += 1
        assert want == collections.Counter((r.doc_id, r.decon_n_words, sum(s.end - s.start for s in r.decon_spans),
                                            tuple(r.decon_items)) for r in got)
    assert decontaminate.decontaminate(docs, table, "spans").filter("doc_id = 9004").first().text == ""
    assert decontaminate.decontaminate(docs, table).filter("doc_id in (9004, 9005)").count() == 0
    assert decontaminate.scan(empty, table).count() == 0
    assert decontaminate.decontaminate(docs, table.limit(0)).count() == len(rows)
    many = decontaminate.scan(docs, table, group_bytes=60)
    assert many.dtypes == decontaminate.scan(docs, table).dtypes
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0  # saved passes, no chained steps
    assert decontaminate.scan(empty, table, group_bytes=60).count() == 0


def test_decontaminate_many_groups(spark):
    shared = "the very same thirteen words stand in all of these items of the benchmark table"
    bench = [(f"i{i:03d}", f"{shared} own{i} tail{i}") for i in range(60)] + [("i000", f"{shared} own0 tail0")]
    table = spark.createDataFrame(bench, "item_id string, text string")
    docs = [(1, f"before {shared} after"), (1, f"before {shared} after"), (None, f"{shared} own7 tail7"), (3, "clean text"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert len(decontaminate.Index([(i, t.encode()) for i, t in bench]).hashes) == 61 * 5
    for group_bytes in (1 << 20, 400):
        got = sorted((r.doc_id or 0, r.decon_n_words, [tuple(s) for s in r.decon_spans], r.decon_items)
                     for r in decontaminate.scan(frame, table, group_bytes=group_bytes).collect())
        every = [f"i{i:03d}" for i in range(60)]
        assert got == [(0, 17, [(0, 17)], every), (1, 17, [(1, 16)], every), (1, 17, [(1, 16)], every), (3, 2, [], []), (4, 0, [], [])]


def test_ngram_lm(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(ngram_lm, "HEAD", 40)
    mu = ngram_lm.MU
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, b, starts = collections.Counter(), collections.Counter(), 0
    for r in rows:
        if not held(r[0]):
            t = words(r[1]) + [None]
            c.update(t)
            b.update(zip(["<s>"] + t[:-1], t))
            starts += 1
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    got = ngram_lm.score(docs.select("doc_id", "text", quality_model.held_out(F.col("doc_id"), 10, 0).alias("held_out"))).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, g in zip(sorted(rows, key=key), sorted(got, key=lambda g: key((g.doc_id,)))):
        t = words(r[1]) + [None]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r[0]), len(t), sum(c[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10(p1(w)) for w in t))
        score = sum(math.log10((b[(x, w)] + mu * p1(w)) / ((starts if x == "<s>" else c[x]) + mu)) for x, w in zip(["<s>"] + t[:-1], t))
        assert g.score == pytest.approx(score, rel=1e-3)
    assert ngram_lm.score(empty.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def test_ngram_lm_hot_pair(spark):
    # a pair of most tokens costs its shard an entry a map block, not one an occurrence
    text, n_docs = "again " * 20_000 + "end", 30
    batch = pa.record_batch([pa.array(range(n_docs)), pa.array([text] * n_docs), pa.array([False] * n_docs)], ["doc_id", "text", "held_out"])
    head = ngram_lm.Head(np.array([ngram_lm.END], np.uint64), np.array([n_docs]), 20_002 * n_docs, 3)
    posted = [p for b in ngram_lm._posting(types.SimpleNamespace(value=head), 8)([batch]) for p in b.to_pylist()]
    assert posted and all(len(p["payload"]) < 1000 for p in posted if p["docs"] is None)
    docs = spark.createDataFrame([(i, text, i == 0) for i in range(n_docs)], "doc_id bigint, text string, held_out boolean")
    got = ngram_lm.score(docs).collect()
    m, n, mu = n_docs - 1, 20_002 * (n_docs - 1), ngram_lm.MU
    p1 = lambda c: (c + 0.1) / (n + 0.1 * 4)
    again = 20_000 * m
    want = (math.log10((m + mu * p1(again)) / (m + mu)) + 19_999 * math.log10((19_999 * m + mu * p1(again)) / (again + mu))
            + math.log10((m + mu * p1(m)) / (again + mu)) + math.log10((m + mu * p1(m)) / (m + mu)))
    base = 20_000 * math.log10(p1(again)) + 2 * math.log10(p1(m))
    assert len(got) == n_docs
    for g in got:
        assert (g.n_tokens, g.n_known, g.train_tokens) == (20_002, 20_002, n)
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(want, rel=1e-3)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 10), (1, 1), (1000, 5000), (500, 1 << 60)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        ef = EliasFano.build(values, universe)
        probe = np.concatenate([values, rng.integers(0, universe, 300).astype(np.uint64)])
        if n:
            assert (ef.successor(probe) == np.searchsorted(values, probe)).all()
        assert ((ef.find(probe) >= 0) == np.isin(probe, values)).all()
        assert (ef.access(np.arange(n)) == values).all()
        if n > 100:  # inside a range of indexes
            lo = rng.integers(0, n, len(probe))
            hi = np.minimum(n, lo + rng.integers(0, 50, len(probe)))
            want = np.clip(np.searchsorted(values, probe), lo, hi)
            assert (ef.successor(probe, lo, hi) == want).all()
            assert ((ef.find(probe, lo, hi) >= 0) == [v in values[a:b] for v, a, b in zip(probe, lo, hi)]).all()


def test_trie_ranges():
    """Each pair is found in its word's range only; the level is no wider than the ranks that its ranges use."""
    rng = np.random.default_rng(4)
    word = rng.integers(0, 60, 3000).astype(np.uint64) << np.uint64(40)
    before = (rng.integers(0, 300, 3000) ** 2).astype(np.uint64) << np.uint64(30)
    pairs = np.unique(np.stack([word, before]), axis=1)
    seen = rng.random(pairs.shape[1]) < 0.6
    count = rng.integers(1, 1000, pairs.shape[1])
    head = ngram_lm.Head(np.array([ngram_lm.END], np.uint64), np.array([9]), 1_000_000, 61)
    tails = np.unique(pairs[0][seen])
    tail_counts = rng.integers(1000, 9000, len(tails))
    trie = ngram_lm.Trie(pairs[0][seen], pairs[1][seen], count[seen], head, (tails, tail_counts))
    of = dict(zip(tails.tolist(), tail_counts.tolist()))
    prior = ngram_lm.MU * head.p1(np.array([of.get(w, 0) for w in pairs[0].tolist()]))
    got = trie.log_numerators(pairs[0], pairs[1], prior)
    assert np.allclose(got, np.log10(np.where(seen, count, 0) + prior), atol=1e-3)
    empty = np.zeros(0, np.uint64)
    none = ngram_lm.Trie(empty, empty, np.zeros(0, np.int64), head, (empty, np.zeros(0, np.int64)))
    assert np.allclose(none.log_numerators(pairs[0], pairs[1], prior), np.log10(prior))


def test_quality_model(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = quality_model.held_out(F.col("doc_id"), 4, 2)
    w = quality_model.fit(docs, labels.filter(~held))
    got = quality_model.score(docs, w).join(labels.filter(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.label == 1) for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x" * 9000)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality_model.score(odd, w).collect())
    assert quality_model.score(empty, w).count() == 0
    none = quality_model.fit(docs, labels.limit(0))
    assert {r.score for r in quality_model.score(odd, none).collect()} == {0.5}


def _plain_features(text):
    """{slot: count} and the number of words, one n-gram at a time, with plain integers."""
    wrap, prime = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & wrap
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & wrap
        return x ^ (x >> 31)

    def fold(values):
        return mix(sum(v * pow(prime, i, 1 << 64) for i, v in enumerate(values)) & wrap)

    def of_bytes(raw):
        return fold([mix(((c + 1) * prime) & wrap) for c in raw])

    def shape(raw):
        kinds = "".join("a" if c >= 0x80 or 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c) for c in raw)
        return re.sub(r"(.)\1+", r"\1", kinds, flags=re.S).encode()

    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    plain, shapes = [of_bytes(w) for w in found], [of_bytes(shape(w)) for w in found]
    out = collections.Counter()
    for tag, (hashes, size) in enumerate([(plain, 1), (plain, 2), (shapes, 1), (shapes, 2), (shapes, 3)]):
        for i in range(len(hashes) - size + 1):
            out[mix((fold(hashes[i:i + size]) + tag) & wrap) >> 46] += 1
    for i, w in enumerate(found):
        out[mix(99 + (i > 0 and w == found[i - 1])) >> 46] += 1
    return out, len(found)


def _plain_model(examples):
    """Follow the regularised leader, a slot at a time; examples are (features, words, label)."""
    q = quality_model
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for found, size, label in examples:
            x = {i: k * q.SCALE / max(1, size) for i, k in found.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            off = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - label
            for i, v in x.items():
                g = off * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    return weight


def test_quality_model_brute_force(spark):
    texts = ["Good plain words about 12 things.", "BUY BUY buy $$$ now now now", "one", "", None, "é 中文 ünï é é", "A1b2 c3  D4\n\tA1b2 A1b2",
             "good words, good words; Good plain words", "now now $$$ 999 999", "x" * 3000 + " end"]
    rows = [(i, texts[i % len(texts)] if i < 20 else f"{texts[i % len(texts)]} {i}") for i in range(40)]
    rows += [rows[1], rows[7], (None, "no id"), (7, "another text of a known id")]
    marks = [(i, int("ood" in (t or ""))) for i, t in rows if i is not None and i % 3] + [(1, 0), (1, None), (None, 1), (999, 1), (7, 0)]
    docs = spark.createDataFrame([(i, t, 5, 6, 7.0) for i, t in rows], "doc_id bigint, text string, label int, order bigint, score double")
    labels = spark.createDataFrame([(i, m, 3) for i, m in marks], "doc_id bigint, label int, order int")
    place = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).distinct().collect()}
    assert len(set(place.values())) == len(place)
    known = collections.defaultdict(set)
    for i, m in marks:
        if i is not None and m is not None:
            known[i].add(m)

    def packed(found, size):
        ids = sorted(found)
        return (np.array(ids + [quality_model.DIMS], np.int32).tobytes(),
                np.append(np.array([found[i] for i in ids]) * (quality_model.SCALE / max(1, size)), 1.0).astype(np.float32).tobytes())

    examples = [(place[i], m, packed(*_plain_features(t)), _plain_features(t)) for i, t in rows if i is not None for m in sorted(known[i])]
    examples.sort(key=lambda e: e[:3])
    weight = _plain_model([(*f, m) for _, m, _, f in examples])
    want = []
    for i, t in rows:
        found, size = _plain_features(t)
        x = sum(weight(s) * k * quality_model.SCALE / max(1, size) for s, k in found.items()) + weight("bias")
        want.append((i is None, i or 0, 1 / (1 + math.exp(-x))))
    shuffled = docs.repartition(5, F.xxhash64("text"))
    for frame in (docs, shuffled):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality_model.score(docs, quality_model.fit(frame, labels)).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], rel=1e-4)


def test_tool_calls(spark):
    calls = [(1, 5, "a", "answer", '{"turn":1,"query":"é"}', []), (1, 4, "b", "answer", '{"query":"q","turn":2}', ["a"]),
             (1, 3, "c", "answer", '{"query":"q","turn":true}', ["b", "zzz"]), (1, 1, "x", "answer", "{}", ["y"]), (1, 2, "y", "answer", "{}", ["x"]),
             (1, 9, "z", "answer", '{"query":"q","turn":2}', ["x"]), (2, 1, "a", "nope", "{}", None), (2, 2, "b", "answer", "{bad", None),
             (2, 3, "c", "answer", None, None), (2, 4, "d", "answer", "[1]", None), (None, 1, "q", "answer", "{}", None),
             (1, 5, "a", "answer", '{"turn":1,"query":"é"}', []), (1, 7, "a", "answer", "{}", [])]
    results = [(1, 6, "a", "A"), (1, 7, "a", "later"), (3, 1, "lost", None), (1, 8, "b", "B")]
    c = spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id bigint, turn bigint, call_id string, content string")
    every = tool_calls.link(c, r).collect()
    assert collections.Counter(x.status for x in every if x.status in ("repeated", "no_identifier")) == {"repeated": 3, "no_identifier": 1}
    got = {(x.conv_id, x.call_id): x for x in every if x.status not in ("repeated", "no_identifier")}
    assert {k: (x.level, x.status) for k, x in got.items()} == {
        (1, "a"): (0, "ok"), (1, "b"): (1, "ok"), (1, "c"): (2, "bad_arguments"), (1, "x"): (None, "cycle"), (1, "y"): (None, "cycle"),
        (1, "z"): (None, "cycle"), (2, "a"): (0, "unknown_tool"), (2, "b"): (0, "bad_json"), (2, "c"): (0, "bad_json"),
        (2, "d"): (0, "bad_arguments"), (3, "lost"): (None, "orphan")}
    assert got[(1, "a")].line == '{"arguments":{"query":"é","turn":1},"conv_id":1,"id":"a","name":"answer","result":"A","status":"ok"}'
    assert all(json.loads(x.line) for x in got.values())
    assert tool_calls.link(c.limit(0), r.limit(0)).count() == 0


def test_pii_skip_chain(spark, docs, rows, empty):
    t = "call +1 (375) 555-4393 or 375 555-4393 now, mail bob.lee@mail.example.com; 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8"
    kinds = {k: [t[a:b] for kk, a, b in pii.base_spans(t) if pii.KINDS[kk] == k] for k in pii.KINDS}
    assert kinds == {"email": ["bob.lee@mail.example.com"], "ip": ["10.0.0.1", "1.2.3.4", "5.6.7.8"], "card": [], "phone": ["+1 (375) 555-4393"]}
    nodes = pii.units(t, pii.base_spans(t))
    unary = np.full((pii.SLOTS, 5), 0.2)
    agree = np.full((5, 5), 0.2) + 20 * np.eye(5)
    found = pii.added(nodes, pii.infer(nodes, unary, np.ones((5, 5)), agree))
    assert [(pii.KINDS[k], t[a:b]) for k, a, b in found] == [("phone", "375 555-4393")]
    got = pii.tag(docs, pii.fit(docs)).collect()
    want = collections.Counter((r[0], ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(r[1] or ""))) for r in rows)
    assert want == collections.Counter((g.doc_id, g.base) for g in got)
    assert all(set(filter(None, g.base.split(","))) <= set(g.spans.split(",")) for g in got)
    assert pii.tag(empty, pii.fit(empty)).count() == 0


def test_pii_fitted(spark):
    """The fitted field finds repeats among many free numbers of their shape, whatever the corpus' size."""
    planted = "call +1 (375) 555-4393 or 375 555-4393 now"
    texts = [planted, "+44 20 7946 0958 again +44 20 7946 0958", "a1b2c3@mail.example.com and a1b2c3@mail.example.com"]
    free = [f"number {200 + i % 700} {100 + i % 900}-{1000 + i} is free" for i in range(60)]
    models = []
    for copies in (1, 40):
        docs = spark.createDataFrame(list(enumerate((texts + free) * copies)), "doc_id bigint, text string")
        model = pii.fit(docs)
        models.append(model)
        got = {r.doc_id: r for r in pii.tag(docs, model).collect()}
        for i, t in enumerate((texts + free) * copies):
            extra = sorted(set(got[i].spans.split(",")) - set(got[i].base.split(",")))
            at = t.find("375 555-4393")
            assert extra == ([f"phone:{at}:{at + 12}"] if t == planted else [])
    for a, b in zip(*models):
        assert np.allclose(a, b)
    far = "+1 (375) 555-4393 and " + "375 555-4393 x9 " * 60
    rows = pii.units(far, pii.base_spans(far))
    found = pii.added(rows, pii.infer(rows, *models[0]))
    assert [far[a:b] for _, a, b in found] == ["375 555-4393"] * 60


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    size, c = suffix_dedup.LENGTH, collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        c.update(b[p:p + size] for p in range(len(b) - size + 1))
    want = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - size + 1):
            if c[b[p:p + size]] > 1:
                cover[p] += 1
                cover[p + size] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert want == collections.Counter(tuple(g) for g in suffix_dedup.dedup(docs).drop("kept").collect())
    assert suffix_dedup.dedup(empty).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(5)
    runs, every = [], []
    for _ in range(7):
        own = sorted({bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(rng.integers(0, 30))})
        every += own
        runs.append(suffix_dedup.Run(suffix_dedup.Run.pack([(s, b"", [(1, 2, 3)]) for s in own])))
    out, last = [], b""
    for shared, run in suffix_dedup.merge(runs):
        assert shared == suffix_dedup.common_prefix(last, run.suffix)
        last = run.suffix
        out.append(last)
    assert out == sorted(every)


def test_mixing(spark, docs, rows, empty):
    sized = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    t = {r.source: r for r in mixing.targets(sized).collect()}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 2 * sizes[s]}
        if not over:
            want |= {s: weight[s] * share for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert {s: pytest.approx(x) for s, x in want.items()} == {s: r.target for s, r in t.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert abs(sum(taken.values()) - sum(want.values())) < 0.25 * sum(want.values())
    assert mixed.exceptAll(mixing.mix(docs)).count() == 0
    assert mixing.mix(empty).count() == 0


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 50_000).astype(np.uint32)
    counts = np.bincount(ids)
    table = rans.Table(np.flatnonzero(counts), counts[counts > 0])
    for n in (0, 1, 511, 512, 513, 131_072, 300_000):
        assert (rans.decode(rans.encode(ids[:n], table), table) == ids[:n]).all()
    damaged = bytearray(rans.encode(ids[:5000], table))
    damaged[-9] ^= 1
    try:
        assert rans.checksum(rans.decode(bytes(damaged), table)) != rans.checksum(ids[:5000])
    except ValueError:
        pass


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    got = token_files.write_and_read(docs).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for g in got:
        assert g.start == at
        at += g.n_tokens
    want = collections.Counter()
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert want == collections.Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got)
    assert token_files.write_and_read(empty).count() == 0


def test_encoder_forgets_and_learns_again(monkeypatch):
    from tokenizers import Tokenizer

    from margin_engine.llm import tokens
    from margin_engine.llm.blocks import Block

    monkeypatch.setattr(tokens, "CACHE", 50)
    path = token_files.default_tokenizer()
    t, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    for k in range(40):
        texts = [f"word{k * i} the {i} of\n\n it's {k}" for i in range(12)]
        raw = [x.encode() for x in texts]
        block = Block(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        ids, offsets = encoder.encode(block)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(encoder.keys) < 50 + 12 * 8


def test_token_files_added_token(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "é 中文 <|endoftext|>x", "<|endoftext", "|> plain", None, "  <|endoftext|>  \n",
             "<|<|endoftext|>|>", "it's <|ENDOFTEXT|> here", "a b c " * 400 + "<|endoftext|>"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = token_files.write_and_read(docs).orderBy("start").collect()
    start = 0
    for g, text in zip(got, texts, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += g.n_tokens


def brute_components(rows):
    sets = {}
    for r in rows:
        w = words(r[1])
        if r[0] is not None:
            sets[r[0]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {i: find(i) for i in ids}


def test_odd_sketch(spark, docs, rows, empty):
    sets, root = brute_components(rows)
    got = odd_sketch.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((g.n_shingles, g.component_id) == (len(sets[g.doc_id]), root[g.doc_id]) for g in got if g.doc_id is not None)
    left = odd_sketch.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(root.values()))
    assert odd_sketch.near_duplicates(empty).count() == 0 and odd_sketch.dedup(empty).count() == 0


def test_open_pairs(spark):
    """Every pair of different components that shares a bucket, and no pair inside the bucket's largest one."""
    r = np.random.default_rng(5)
    n = {i: int(r.integers(90, 220)) for i in range(60)}
    root = {i: 0 for i in range(40)} | {i: i // 3 * 3 for i in range(40, 60)}
    band = [(1, i) for i in range(60)] + [(2, i) for i in range(40)] + [(b, int(i)) for b in range(3, 9) for i in r.choice(60, 12, False)]
    members = spark.createDataFrame(band, "band bigint, rep bigint")
    found = spark.createDataFrame([(i, x) for i, x in root.items() if i < 50], "node bigint, root bigint")
    root |= {i: i for i in range(50, 60)}
    sketches = spark.createDataFrame([(i, x, [0] * 8, [0] * 16) for i, x in n.items()],
                                     "rep bigint, n bigint, sketch array<bigint>, parity array<bigint>")
    got = [(min(x.u, x.v), max(x.u, x.v)) for x in odd_sketch.open_pairs(members, found, sketches).collect()]
    size = lambda i: math.floor(math.log(n[i]) / math.log(4 / 3))
    want = [(i, j) for b in range(1, 9) for i in sorted(x for c, x in band if c == b) for j in sorted(x for c, x in band if c == b)
            if i < j and root[i] != root[j] and abs(size(i) - size(j)) <= 1]
    assert collections.Counter(got) == collections.Counter(want)
    # the plan pairs rows outside the largest component with the bucket, so 40 linked members cost 40 an outside row
    hot = odd_sketch.open_pairs(members.filter("band = 1 and rep < 41"), found, sketches.withColumn("n", F.lit(100).cast("bigint")))
    assert hot.count() == 40 and hot.select("u").distinct().count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_quality_rules(spark, docs, rows, empty):
    got = quality_rules.apply_rules(docs.drop("kept"))
    want = collections.Counter()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(cover),
              len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    m = "quality_m."
    assert want == collections.Counter(tuple(x) for x in got.select(
        "doc_id", *[m + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed").collect())
    assert got.filter("base_failed and kept").count() == 0
    assert quality_rules.apply_rules(empty.drop("kept")).count() == 0


def test_set_sketch_bound():
    """The XOR count of two set sketches is at most the size of the sets' difference."""
    r = np.random.default_rng(3)
    for n, changed in ((50, 3), (400, 60), (3000, 900)):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[changed:], r.integers(0, 1 << 63, changed, dtype=np.uint64)])
        x, y = odd_sketch.set_sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        count = int(np.bitwise_count(x ^ y).sum())
        assert changed // 8 < count <= 2 * changed
    assert odd_sketch.set_sketches(np.zeros(0, np.uint64), np.array([0, 0])).sum() == 0
