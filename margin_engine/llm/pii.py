"""Personal data: base patterns and a skip-chain conditional random field.

Base spans come from four linear-time matchers.  Units (number phrases and words
with a digit or @) are the nodes of a random field with labels none, email,
ip, card, phone.  Potentials are trained piecewise over all documents, with
the base spans as labels and the labels of all other units hidden: a hidden label
says nothing (every label alike), so pairs count where both ends are base units,
each of which is predicted from the other as if masked.  Unit features (hashed to ``SLOTS``),
label pairs of neighbouring units, and label pairs of skip links are each a bounded table of
counts summed by Spark; only their shares are used, smoothed by a share of ``EPS``, so a
corpus and its copies give the same potentials.  Skip links join a unit to the one before and to the first base unit that share a key (their
last seven digits, their letters and digits, the part before @), so repeated and
similar tokens share potentials at linear cost.  Loopy sum-product messages
run per document, with base units clamped, until they settle; a free unit that ends with a
label at ``SURE`` or more and a skip path to a base unit of that kind becomes a
span.  Base spans always stay.

Offsets are code points, end exclusive.  Defined cases: a null or empty text
has no spans; a null doc_id is kept; repeated rows are judged each; an empty table gives no rows;
further columns are ignored.  Memory is bounded by the longest document.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks

KINDS = ("email", "ip", "card", "phone")
SLOTS = 1 << 14
SURE = 0.8
ROUNDS = 100  # and eight a unit, if messages have not settled by then
EPS = 0.1
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_UNIT = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*(?![A-Za-z0-9@_])|[A-Za-z0-9._%+@-]+")


def emails(t: str):
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ outwards."""
    end, k = 0, t.find("@")
    while k >= 0:
        a = k
        while a > end and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, k + 1) if a < k else None
        if m:
            yield a, m.end()
            end = m.end()
        k = t.find("@", max(k + 1, end))


def ips(t: str):
    """Four dotted parts at a time along each dotted chain; parts at most 255."""
    for m in _CHAIN.finditer(t):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(t: str):
    for m in _CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(t: str):
    for m in _PHONE.finditer(t):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(t: str):
    """[(kind index, start, end)] by kind, then start."""
    return [(k, a, b) for k, f in enumerate((emails, ips, cards, phones)) for a, b in f(t)]


def _shape(s: str) -> str:
    out = []
    for c in s:
        c = "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def units(t: str, spans):
    """[(start, end, label, feature slot, keys)]: base spans are units themselves; the others lie between."""
    out = [(a, b, k + 1) for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    for m in _UNIT.finditer(t):
        a, b = m.span()
        text = m.group()
        if not ("@" in text or any("0" <= c <= "9" for c in text)):
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        out.append((a, b, 0))
    rows = []
    for a, b, label in sorted(out):
        text = t[a:b]
        digits = "".join(c for c in text if "0" <= c <= "9")
        slot = zlib.crc32(f"{_shape(text)}|{min(len(digits), 20)}".encode()) % SLOTS
        keys = []
        if len(digits) >= 7:
            keys.append("d" + digits[-7:])
        plain = "".join(c for c in text.lower() if c.isalnum())
        if len(plain) >= 6:
            keys.append("p" + plain)
        if "@" in text and len(text.split("@")[0]) >= 5:
            keys.append("p" + "".join(c for c in text.split("@")[0].lower() if c.isalnum()))
        rows.append((a, b, label, slot, keys))
    return rows


def graph(rows):
    """(chain edges, skip edges): neighbours, and units that share a key with the unit before or the key's first base unit."""
    first, last, skip = {}, {}, set()
    for i, row in enumerate(rows):
        for key in row[4] if row[2] else ():
            first.setdefault(key, i)
    for i, row in enumerate(rows):
        for key in row[4]:
            for j in (last.get(key, i), first.get(key, i)):
                if j != i:
                    skip.add((min(i, j), max(i, j)))
            last[key] = i
    return [(i, i + 1) for i in range(len(rows) - 1)], sorted(skip)


def infer(rows, unary, chain, skip):
    """Marginals (units, labels) of loopy sum-product; unary is (SLOTS, labels), chain and skip are (labels, labels)."""
    pairs, links = graph(rows)
    local = np.maximum(unary[[r[3] for r in rows]], 1e-9)
    for i, r in enumerate(rows):
        if r[2]:
            local[i] = 1e-9
            local[i, r[2]] = 1.0
    edges = np.array(pairs + links, dtype=np.int64).reshape(-1, 2)
    if not len(edges):
        return local / local.sum(1, keepdims=True)
    tables = np.concatenate([np.repeat(chain[None], len(pairs), 0), np.repeat(skip[None], len(links), 0)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    log_local = np.log(local)
    messages = np.zeros((len(src), local.shape[1]))
    for _ in range(ROUNDS + 8 * len(rows)):
        belief = log_local.copy()
        np.add.at(belief, dst, messages)
        out = belief[src] - messages[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ea,eab->eb", out, tables), 1e-12))
        new -= new.max(1, keepdims=True)
        new = 0.5 * (messages + new)
        if np.abs(new - messages).max() < 1e-4:
            messages = new
            break
        messages = new
    belief = log_local.copy()
    np.add.at(belief, dst, messages)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def added(rows, marginals):
    """Spans of free units with a sure label and a skip path to a base unit of that kind."""
    _, links = graph(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    base = {(find(i), r[2]) for i, r in enumerate(rows) if r[2]}
    best = marginals.argmax(1)
    return [(int(best[i]) - 1, r[0], r[1]) for i, r in enumerate(rows)
            if not r[2] and best[i] and marginals[i, best[i]] >= SURE and (find(i), int(best[i])) in base]


def _texts(batches):
    """(rows, [text or '' when neither digit nor @ occurs]) of each block."""
    for batch in batches:
        for rows, block in blocks(batch, "text"):
            data = block.data
            mark = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
            has = np.zeros(len(block), dtype=bool)
            has[np.searchsorted(block.offsets, mark, side="right") - 1] = True
            yield rows, [block.text(i).decode("utf-8") if has[i] else "" for i in range(len(block))]


def _count(batches):
    n = len(KINDS) + 1
    unary, pair = np.zeros((SLOTS, n), np.int64), np.zeros((2, n, n), np.int64)
    for _, texts in _texts(batches):
        for t in filter(None, texts):
            rows = units(t, base_spans(t))
            for r in rows:
                unary[r[3], r[2]] += 1
            for kind, edges in enumerate(graph(rows)):
                for a, b in edges:
                    if rows[a][2] and rows[b][2]:
                        pair[kind, rows[a][2], rows[b][2]] += 1
    flat = np.concatenate([unary.ravel(), pair.ravel()])
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["cell", "n"])


def fit(docs: DataFrame):
    """(unary, chain, skip) potentials from the counts over all documents: SLOTS * 5 + 50 numbers at most."""
    n = len(KINDS) + 1
    got = docs.select("text").mapInArrow(_count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(SLOTS * n + 2 * n * n)
    flat[got["cell"].to_numpy()] = got["n"].to_numpy()
    unary = flat[:SLOTS * n].reshape(SLOTS, n)
    unary = np.concatenate([np.zeros((SLOTS, 1)), unary[:, 1:]], 1) + unary[:, :1] / n  # hidden labels: any alike
    unary = _shares(unary, n)
    near, linked = (pair + pair.T for pair in flat[SLOTS * n:].reshape(2, n, n))
    chain = np.ones((n, n))
    if near.any():
        joint = near[1:, 1:] / near.sum()
        own = joint.sum(1)
        alone = np.outer(own, own)
        # association beyond the labels' own frequency; kinds without a pair have none
        chain[1:, 1:] = np.where(alone > 0, (1 - EPS) * joint / np.maximum(alone, EPS / n ** 2) + EPS, 1.0)
    skip = _shares(linked, n)
    return unary, chain, np.sqrt(skip * skip.T)


def _shares(counts, n: int):
    """Each row's shares, ``EPS`` of them spread evenly; even for rows without counts."""
    total = counts.sum(1, keepdims=True)
    return np.where(total > 0, (1 - EPS) * counts / np.maximum(total, 1e-9) + EPS / n, 1 / n)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def tag(docs: DataFrame, model) -> DataFrame:
    """(doc_id, base, spans): base and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, texts in _texts(batches):
            base, every, counts, digest = [], [], [], []
            for t in texts:
                spans = base_spans(t) if t else []
                more = []
                if spans:  # without a base unit nothing can be added
                    nodes = units(t, spans)
                    more = added(nodes, infer(nodes, *shared.value))
                text = _join(spans)
                base.append(text)
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                every.append(_join(sorted(spans + more)))
                counts.append([sum(k == i for k, _, _ in spans) for i in range(len(KINDS))])
            by_kind = list(zip(*counts)) if counts else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in by_kind], pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(base, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "base"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, base string")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tag(docs, fit(docs)).drop("base")
