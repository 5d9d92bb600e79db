"""URL filters, Merkle manifest and conversation repair against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from margin_engine.llm import conversation_repair as repair
from margin_engine.llm import merkle, url_filter


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------ URL filters

URLS = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/de/x?y#z", "http://example.com", "http://example.com/", "x://a.net/en/",
        "http://sub.example.net/en/1://b", "http://Example.net/En/", "http://notexample.com/de/", "http://org/fr/", "http://.org/fr/q", "http://a..net/",
        "http://net", "http://net?/", "http://net#/", "http://a.net:80/", "http://u@example.com/de/", "https://é.example.com/de/日本", "http://x.net/\nen",
        "http://" + ".".join("abcdefghij" * 60) + ".net/" + "p/" * 5000, "http://İ.org/fr/"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("com", "", "block"),
         ("www.example.com", "/d", "allow"), ("com", "/de/x", "allow"), ("org", "/fr/", "block"), (None, "/", "block"), ("net", None, "block"),
         ("net", "/", None), ("net", "en", "block"), ("", "/", "block"), ("NET", "/p", "other"), ("net", "/p/p/p", "block")]


def judge(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fits = [(len(low(h) + p), len(h), low(h) + p, "block" if v == "block" else "allow") for h, p, v in rules
            if h and p is not None and v is not None and (p == "" or p[0] == "/")
            and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.fixture(scope="module")
def pages(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[5])] * 40 + [(None, URLS[5])]
    return spark.createDataFrame([(i, u, "h", "x", "y") for i, u in rows], "page_id bigint, url string, host string, url_rule string, digest string")


@pytest.mark.parametrize("rules", [RULES, list(url_filter.RULES), []])
@pytest.mark.parametrize("small", [True, False])
def test_url_filter(spark, pages, rules, small, monkeypatch):
    if not small:
        monkeypatch.setattr(url_filter, "bounded_broadcast", lambda df: (df, False))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = collections.Counter((r.page_id, r.host, r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in url_filter.judge(pages, table).collect())
    want = collections.Counter((r.page_id, "h", *judge(r.url, rules)) for r in pages.collect())
    assert got == want
    kept = url_filter.keep(pages, table)
    assert kept.columns == pages.columns
    assert kept.count() == sum(n for k, n in want.items() if k[-1] == "allow")
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_short_prefixes_are_confirmed(spark, pages, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX", 0)  # every prefix collides
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.url_rule) for r in url_filter.judge(pages, table).collect()}
    assert got == {(r.page_id, judge(r.url, RULES)[2]) for r in pages.collect()}


# ------------------------------------------------------------------ Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fan):
    """(root, path of each node): path entries are (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for j, p in enumerate(at):
            run = runs[p // fan]
            paths[j].append(("".join(run[:p % fan]), "".join(run[p % fan + 1:])))
        nodes, at = [H(*r) for r in runs], [p // fan for p in at]
    return (nodes[0] if nodes else None), paths


def brute_manifest(rows, fan=merkle.FAN):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((-1 if r[0] is None else r[0], leaf(r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, own = [], {}
    for g in order:
        members = sorted(groups[g], key=lambda x: x[:2])
        sub, paths = climb([m[1] for m in members], fan)
        subroots.append(sub)
        own[g] = [(m, sub, p) for m, p in zip(members, paths)]
    root, tops = climb(subroots, fan)
    out = collections.Counter()
    for g, top in zip(order, tops):
        for (_, digest, r), sub, path in own[g]:
            path = path + top
            start = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                start = leaf([*r[:4], None if r[4] is None else low(r[4])])
            folded = start
            for before, after in path:
                folded = H(before, folded, after)
            out[(r[0], digest, sub, root, H(*[b + a for b, a in path]), folded, folded == root)] += 1
    return out


def run_manifest(spark, rows, path):
    spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 1) for r in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, rank int").repartition(3).write.parquet(f"{path}/documents.parquet")
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return collections.Counter(tuple(r[c] for c in cols) for r in merkle.op12(spark, str(path)).collect())


def test_merkle_manifest(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "Ä", "b"]) if i % 3 else "hot", rng.choice([None, "en"]), rng.choice([None, i]),
             rng.choice([None, "", "Text É %d" % i, "low %d" % i, "LONG " * 4000])) for i in range(620)]
    rows += [(7, "hot", None, None, "SAME")] * 40 + [(None, "hot", None, None, "n"), (None, None, None, None, None), (8, "lone", "en", 1, "Z")]
    assert run_manifest(spark, rows, tmp_path / "all") == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(5, "a", None, 1, "ONE")], [(i, "a", "x", 1, "T") for i in range(16)], [(i, "a", "x", 1, "T") for i in range(17)],
                                  [(i, f"s{i:03}", "x", 1, "T") for i in range(40)]])
def test_merkle_shapes(spark, tmp_path, rows):
    got = run_manifest(spark, rows, tmp_path / "t")
    assert got == brute_manifest(rows)
    assert all(k[-1] for k in got if zlib.crc32(str(k[0]).encode()) % 5)


def test_manifest_of_other_fan(spark):
    rows = spark.range(30).select("id", F.lit("g").alias("g"))
    got = {r.id: (r.root, [(s.before, s.after) for s in r.path]) for r in merkle.manifest(rows, "g", "id", merkle.leaf_of([F.col("id")]), fan=2).collect()}
    root, paths = climb([leaf([i]) for i in range(30)], 2)
    assert got == {i: (root, paths[i]) for i in range(30)}


# ------------------------------------------------------------------ conversation repair

SPACE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(SPACE)
        kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """Least (cost, audit, lines) by search over (row, initials' state as the text of roles so far)."""
    legal = re.compile(r"(s?(ua)+)?")
    prefix = lambda roles: any(legal.fullmatch(roles + end) for end in ("", "a", "ua", "uaa"[:2]))
    short = lambda roles: roles[-1:] if roles else ""
    layer = {"": (0, "", [])}
    full = {"": "", "s": "s", "u": "u", "a": "ua"}

    def spread(layer):
        for _ in range(3):
            for st, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    if prefix(full[st] + role[0]):
                        new, st2 = (cost + 2, audit + "I", lines + [role + ":"]), short(full[st] + role[0])
                        if st2 not in layer or new < layer[st2]:
                            layer[st2] = new
        return layer

    for (role, text), kind in zip(rows, kinds):
        nxt = {}
        for st, (cost, audit, lines) in spread(layer).items():
            moves = [(st, cost + 3, "D", [])]
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                options = [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]
                moves += [(short(full[st] + r[0]), cost + c + late, e, [r + ":" + text]) for r, c, e in options
                          if r and r[0] in "sua" and prefix(full[st] + r[0])]
            for st2, c, e, line in moves:
                new = (c, audit + e, lines + line)
                if st2 not in nxt or new < nxt[st2]:
                    nxt[st2] = new
        layer = nxt
    return min(v for st, v in spread(layer).items() if legal.fullmatch(full[st]))


def test_brute_force_is_the_definition():
    """The search above equals enumeration of all edit sequences on tiny conversations."""
    for roles in itertools.chain.from_iterable(itertools.product("suax", repeat=n) for n in range(4)):
        rows = [(r, f"t{i}.") for i, r in enumerate(roles)]
        best = None
        slots = [["", "u", "a", "ua", "au"]] * (len(rows) + 1)
        for edits in itertools.product("DKR", repeat=len(rows)):
            for ins in itertools.product(*slots):
                for as_role in itertools.product(*["ua" if e == "R" else "-" for e in edits]):
                    got = "".join(i + {"D": "", "K": r[0], "R": a}[e] for i, e, r, a in zip(ins, edits, rows, as_role)) + ins[-1]
                    if re.fullmatch(r"(s?(ua)+)?", got):
                        cost = sum({"D": 3, "K": 0, "R": 2}[e] for e in edits) + 2 * sum(map(len, ins))
                        audit = "".join("I" * len(i) + e for i, e in zip(ins, edits)) + "I" * len(ins[-1])
                        best = min(best or (cost, audit), (cost, audit))
        assert cheapest(rows, faults(rows))[:2] == best


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        out[conv]
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    want = {}
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        turns = [t for t, _, _ in kept if t is not None]
        said = [(r, t) for _, r, t in kept]
        kinds = faults(said)
        cost, audit, lines = cheapest(said, kinds)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        want[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                      kinds.count("truncated"), illegal, cost, audit, H("\n".join(lines)))
    return want


def conversations(seed, n):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "Yes.", "No", "Why? \t", "Fine!", "é 中。", "a.b", ". x", "Yes.\u0085"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30 if conv == 3 else 4])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "User"]),
                         rng.choice(texts) if rng.random() < .4 else f"text {rng.random()}" + rng.choice([".", "!", "", " "])))
    rows += [(900, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(260)] + [(901, i, rng.choice(["user", "assistant", "system", "x"]), f"t{i}") for i in range(150)]
    rows += [(902, 5, "user", "same.")] * 50 + [(903, 1, "user", "x." * 60000), (903, 2, "assistant", "y.")]
    return rows


@pytest.mark.parametrize("block", [3, 64, repair.BLOCK])
def test_conversation_repair(spark, block):
    rows = conversations(3, 60)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, block int").repartition(5)
    got = repair.with_empty(repair.repair(repair.damage(table), block), table).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repair_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.with_empty(repair.repair(repair.damage(table)), table).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], table.schema)
    assert [tuple(r) for r in repair.with_empty(repair.repair(repair.damage(one)), one).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", H(""))]
