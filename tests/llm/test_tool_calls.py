"""Tool-call linking against brute force: level, status, order, lines; texts that break parsers."""

import collections
import json
import random

import pytest

from margin_engine.llm import tool_calls

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>, level int, row string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, called string, fault int"
ODD = ['{"query":"q","turn":1e999}', '{"query":"\\ud800","turn":1}', '{"query":"\\ud83d\\ude00","turn":1}', "[" * 100000, '{"a":' * 5000 + "1" + "}" * 5000,
       '{"query":"q","turn":NaN}', '{"query":"q","turn":' + "9" * 5000 + "}", '{"query":"a","query":"b","turn":1}', "", " ", "null", "{}", '"x"',
       '{"query":"q","turn":1.0}', '{"query":"q","turn":true}', '{"query":"q","turn":1,"more":0}', '{"turn":1,"query":"é\\u0000"}', '﻿{}', None]


def brute(calls, results):
    """Counter of (conv_id, call_id, level, turn, status)."""
    out = collections.Counter()
    low = lambda v: tuple((x is not None, x if not isinstance(x, list) else tuple(x)) for x in v)
    firsts, answers = {}, {}
    for table, kept, cols in ((calls, firsts, lambda c: (c[1], c[3], c[4], sorted(c[5] or []))), (results, answers, lambda r: (r[1], r[3]))):
        groups = collections.defaultdict(list)
        for x in table:
            if x[0] is None or x[2] is None:
                out[(x[0], x[2], None, x[1], "no_identifier")] += 1
            else:
                groups[x[0], x[2]].append(x)
        for key, xs in groups.items():
            xs.sort(key=lambda x: low(cols(x)))
            kept[key] = xs[0]
            for x in xs[1:]:
                out[(*key, None, x[1], "repeated")] += 1
    level = {}
    for _ in firsts:  # longest paths by relaxation; whatever still waits is on or behind a cycle
        for key, c in firsts.items():
            deps = {(key[0], d) for d in c[5] or []} & set(firsts)
            if deps <= set(level):
                level[key] = 1 + max((level[d] for d in deps), default=-1)
    for key, c in firsts.items():
        status, _ = tool_calls.validate(c[3], c[4], tool_calls.TOOLS)
        status = "cycle" if key not in level else status or ("ok" if key in answers else "no_result")
        out[(*key, level.get(key), c[1], status)] += 1
    for key, r in answers.items():
        if key not in firsts:
            out[(*key, None, r[1], "orphan")] += 1
    return out


def some(seed):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    ids = [f"c{i}" for i in range(9)] + [None]
    calls = [(pick([1, 2, 3, None]), pick([None, 1, 2, 3]), pick(ids), pick(["answer", "configure", "none", None]),
              pick(ODD + ['{"query":"q","turn":2}'] * 20), pick([None, [], [pick(ids[:-1])], [pick(ids[:-1]), "unknown"], [pick(ids[:-1])] * 2])) for _ in range(60)]
    calls += [(7, i, f"k{i}", "answer", '{"query":"q","turn":2}', [f"k{i - 1}"] if i else []) for i in range(40)] + [calls[0]] * 3
    results = [(pick([1, 2, 3, 8, None]), pick([None, 1, 5]), pick(ids), pick([None, "", "x"])) for _ in range(40)]
    return calls, results


def frames(spark, calls, results):
    return (spark.createDataFrame([(*c, 5, "clash") for c in calls], CALLS).repartition(3),
            spark.createDataFrame([(*r, "clash", 1) for r in results], RESULTS).repartition(2))


@pytest.mark.parametrize("local", [tool_calls.LOCAL, 12])
def test_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(tool_calls, "LOCAL", local)  # 12: the longer conversations go by rounds
    calls, results = some(local)
    got = tool_calls.link(*frames(spark, calls, results)).collect()
    assert collections.Counter((x.conv_id, x.call_id, x.level, x.turn, x.status) for x in got) == brute(calls, results)
    assert len(got) >= len(calls)
    place = {}
    for i, x in enumerate(got):  # a call comes after those whose results it uses
        if x.status not in ("repeated", "no_identifier", "orphan"):
            place[x.conv_id, x.call_id] = (i, x.level)
    for (conv, _), own in place.items():
        assert all(own[0] > other[0] for (c, _), other in place.items() if c == conv and None not in (own[1], other[1]) and other[1] < own[1])
    for x in got:
        line = json.loads(x.line)
        assert list(line) == sorted(line) and (line["id"], line["status"]) == (x.call_id, x.status)


def test_a_long_chain_is_levelled_in_one_pass(spark):
    n = 1000
    calls = [(1, n - i, f"k{i:04}", "answer", '{"query":"q","turn":2}', [f"k{i - 1:04}"] if i else []) for i in range(n)]
    c, r = frames(spark, calls, [])
    assert sorted((x.call_id, x.level) for x in tool_calls.levels(c).collect()) == [(f"k{i:04}", i) for i in range(n)]


def test_texts_that_break_parsers():
    want = {0: "bad_json", 1: "", 2: "", 3: "bad_json", 5: "bad_json", 6: "bad_json", 7: "", 8: "bad_json", 9: "bad_json", 10: "bad_arguments",
            11: "bad_arguments", 12: "bad_arguments", 13: "bad_arguments", 14: "bad_arguments", 15: "bad_arguments", 16: "", 17: "bad_json", 18: "bad_json"}
    for i, text in enumerate(ODD):
        status, canon = tool_calls.validate("answer", text, tool_calls.TOOLS)
        assert status == want.get(i, status), text[:30]
        if canon:
            canon.encode()
            assert tool_calls.canonical(json.loads(canon)) == canon
    assert tool_calls.validate("answer", ODD[1], tool_calls.TOOLS)[1] == '{"query":"\\ud800","turn":1}'
    assert tool_calls.validate("answer", ODD[2], tool_calls.TOOLS)[1] == '{"query":"😀","turn":1}'


def test_stand_in_meets_every_status(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    odd = spark.createDataFrame([(1, 0, None, "x"), (None, 0, "user", "x"), (1, None, "user", None), (9999, 5, "assistant", "lost"), (9998, 0, "user", "x"),
                                 (9998, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    calls, results = tool_calls.stand_in(conv.unionByName(odd))
    assert calls.count() + results.count() == conv.count() + 6
    got = tool_calls.link(calls, results).collect()
    linked = {(x.conv_id, x.call_id) for x in got if x.status not in ("repeated", "no_identifier", "orphan")}
    answered = sum((r.conv_id, r.call_id) in linked for r in results.dropDuplicates(["conv_id", "call_id"]).collect() if r.conv_id is not None and r.call_id is not None)
    assert len(got) + answered == conv.count() + 6
    assert {x.status for x in got} == {"no_identifier", "repeated", "cycle", "unknown_tool", "bad_json", "bad_arguments", "no_result", "ok", "orphan"}
