"""Chat formatting: link tool calls to their results.

Input: ``calls`` (conv_id, turn, call_id, name, arguments as JSON text, after:
ids of calls whose results it uses) and ``results`` (conv_id, turn, call_id,
content).  Calls and results hash-join by (conv_id, call_id), so a
conversation that holds a third of all rows spreads over its identifiers.

Topological levels (one more than the deepest dependency): conversations of at most ``LOCAL`` calls and
dependencies are dealt whole and levelled in linear time in a stream; a longer one is levelled by rounds of
joins over its identifiers, one round a level, each written once.  The order of a
conversation is (level, turn, call_id) and is dealt by range, not by
conversation.  Arguments are validated against the tool's schema and
serialised with sorted keys and no spaces.

Every row of both tables gives one row.  Status, the first that holds: ``no_identifier`` (null conv_id or
call_id), ``repeated`` (a call or result of an identifier that has one of an earlier turn, or of the same turn and
smaller), ``cycle`` (on or behind a cycle of dependencies), ``unknown_tool``, ``bad_json``, ``bad_arguments``,
``no_result``, ``ok``; results without a call are ``orphan``; a linked result is part of its call's row.
Defined cases: null arguments, numbers beyond a double, NaN and nesting deeper than the parser takes are
``bad_json``; of repeated keys in an object the last counts; lone surrogates are written as escapes; unknown
dependencies are ignored; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize, shared_folder
from .conversation_repair import _whole_groups

LOCAL = 200_000
#: tool -> argument -> (kind, required)
TOOLS = {
    "answer": {"query": ("string", True), "turn": ("integer", True)},
    "configure": {"query": ("string", True), "turn": ("integer", True), "strict": ("boolean", False)},
}
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _reject(text):
    raise ValueError(text)


def _finite(text):
    x = float(text)
    return x if math.isfinite(x) else _reject(text)


def validate(name: str | None, arguments: str | None, tools: dict):
    """(status or '', canonical arguments or None)."""
    if name not in tools:
        return "unknown_tool", None
    try:
        value = json.loads(arguments, parse_constant=_reject, parse_float=_finite)
        text = canonical(value)
    except (TypeError, ValueError, RecursionError):
        return "bad_json", None
    if not isinstance(value, dict):
        return "bad_arguments", text
    schema = tools[name]
    good = all(k in value for k, (_, required) in schema.items() if required) and all(
        k in schema and isinstance(v, _KINDS[schema[k][0]]) and (not isinstance(v, bool) or schema[k][0] == "boolean")
        for k, v in value.items())
    return ("" if good else "bad_arguments"), text


def local_levels(ids: list[str], after: list[list[str]]) -> list[int | None]:
    """Levels of one conversation's calls; None on or behind a cycle."""
    place = {c: i for i, c in enumerate(ids)}
    users, waits = [[] for _ in ids], [0] * len(ids)
    for i, deps in enumerate(after):
        for d in set(deps):
            if d in place:
                users[place[d]].append(i)
                waits[i] += 1
    level = [0] * len(ids)
    ready = [i for i, n in enumerate(waits) if not n]
    for i in ready:  # grows while it is walked
        for j in users[i]:
            level[j] = max(level[j], level[i] + 1)
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return [lv if not n else None for lv, n in zip(level, waits)]


def _level_batches(batches):
    for table, starts in _whole_groups(batches, 1):
        ids, after = table.column("call_id").to_pylist(), table.column("after").to_pylist()
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            out += local_levels(ids[a:b], after[a:b])
        yield pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks(), table.column("call_id").combine_chunks(), pa.array(out, pa.int32())],
                                         names=["conv_id", "call_id", "level"])


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """Levels of conversations too long for one task: a round of joins a level."""
    spark = calls.sparkSession
    path = shared_folder(spark, "levels")
    key = ["conv_id", "call_id"]
    ids = materialize(calls.select(*key), "ids")
    waiting = materialize(calls.select(*key, F.explode("after").alias("dep")).distinct()
                          .join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]), "depends")
    level = 0
    ids.join(waiting.select(*key).distinct(), key, "left_anti").write.parquet(f"{path}/level=0")
    while True:
        met = spark.read.parquet(f"{path}/level={level}").select("conv_id", F.col("call_id").alias("dep"))
        left = materialize(waiting.join(met, ["conv_id", "dep"], "left_anti"), "depends")
        ready = materialize(waiting.select(*key).distinct().join(left.select(*key).distinct(), key, "left_anti"), "ready")
        waiting = left
        if not ready.limit(1).count():
            break
        level += 1
        ready.write.parquet(f"{path}/level={level}")
    done = spark.read.schema("conv_id bigint, call_id string, level int").parquet(path)
    return done.union(waiting.select(*key).distinct().withColumn("level", F.lit(None).cast("int")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): null level on or behind a cycle."""
    long = materialize(calls.groupBy("conv_id").agg(F.sum(F.lit(1) + F.size("after")).alias("n")).filter(F.col("n") > LOCAL).select("conv_id"), "long")
    short = calls.select("conv_id", "call_id", "after").join(long, "conv_id", "left_anti")
    out = short.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_level_batches, "conv_id bigint, call_id string, level int")
    if long.limit(1).count():
        out = out.union(_levels_by_rounds(calls.join(long, "conv_id", "left_semi")))
    return out


_LINKED = "conv_id bigint, call_id string, level int, turn bigint, status string, line string"


def _lines(tools: dict):
    def run(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                arguments = None
                if x["fault"]:
                    status = x["fault"]
                elif not x["called"]:
                    status = "orphan"
                else:
                    status, arguments = validate(x["name"], x["arguments"], tools)
                    status = "cycle" if x["level"] is None else status or ("ok" if x["answered"] else "no_result")
                rest = canonical({"conv_id": x["conv_id"], "id": x["call_id"], "name": x["name"], "result": x["content"], "status": status})
                out.append((x["conv_id"], x["call_id"], x["level"], x["turn"], status, f'{{"arguments":{arguments or "null"},{rest[1:]}'))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["conv_id", "call_id", "level", "turn", "status", "line"])

    return run


def _firsts(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``fault``: null for the first row of an identifier (least in ``order``).

    The order ends in the row's number in the input; an identifier's rows meet as partial minima of numbers, not in a window."""
    rows = materialize(df.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = rows.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(*order, "row")).alias("m")).select(F.col("m.row").alias("first_row"))
    unnamed = F.col("conv_id").isNull() | F.col("call_id").isNull()
    return rows.join(first, F.col("row") == F.col("first_row"), "left").withColumn(
        "fault", F.when(unnamed, "no_identifier").when(F.col("first_row").isNull(), "repeated")).drop("row", "first_row")


def link(calls: DataFrame, results: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per call and per result without a call's row: conv_id, call_id, level, turn, status, line (canonical JSON)."""
    tools = TOOLS if tools is None else tools
    key = ["conv_id", "call_id"]
    after = F.array_sort(F.coalesce("after", F.array().cast("array<string>"))).alias("after")
    c = materialize(_firsts(calls.select(*key, "turn", "name", "arguments", after), ["turn", "name", "arguments", "after"]), "calls")
    r = materialize(_firsts(results.select(*key, "turn", "content"), ["turn", "content"]), "results")
    good = c.filter("fault is null").drop("fault")
    answers = r.filter("fault is null").select(*key, F.struct("turn", "content").alias("r"))
    linked = good.join(levels(good), key, "left").withColumn("called", F.lit(True)).join(answers, key, "full_outer").select(
        *key, "level", F.when(F.col("called"), F.col("turn")).otherwise(F.col("r.turn")).alias("turn"), "name", "arguments", F.coalesce("called", F.lit(False)).alias("called"),
        F.col("r").isNotNull().alias("answered"), F.col("r.content").alias("content"), F.lit(None).cast("string").alias("fault"))
    faulty = c.filter("fault is not null").withColumn("content", F.lit(None).cast("string")).unionByName(
        r.filter("fault is not null"), allowMissingColumns=True).select(
        *key, F.lit(None).cast("int").alias("level"), "turn", "name", "arguments", F.lit(False).alias("called"), F.lit(False).alias("answered"), "content", "fault")
    # written before the deal by range, which looks at its rows twice
    rows = materialize(linked.unionByName(faulty).mapInArrow(_lines(tools), _LINKED), "linked")
    order = ["conv_id", "level", "turn", "call_id", "status"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def stand_in(conversations: DataFrame):
    """Rows in the operator's schema from chat turns: an assistant's turn answers the turn before it (a result), any other
    asks (a call; a role that no tool has, null included, names an unknown tool).  A call may use the call of turn 2 * (turn
    div 4); by the crc32 of ``conv_id:turn`` modulo 50, 0 lets it use itself, 1 cuts its arguments off, 2 quotes its turn."""
    is_result = F.col("role").eqNullSafe(F.lit("assistant"))
    named = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    hit = F.coalesce(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))) % 50, F.lit(3))
    name = F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "answer").otherwise(F.col("role"))
    plain = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn")))
    quoted = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").cast("string").alias("turn")))
    arguments = F.when(hit == 1, F.expr("left(plain, length(plain) - 1)")).when(hit == 2, quoted).otherwise(F.col("plain"))
    earlier = F.when(F.col("turn") >= 2, named(F.expr("2 * (turn div 4)")))
    itself = F.when(hit == 0, named(F.col("turn")))
    calls = conversations.filter(~is_result).withColumn("plain", plain).select(
        "conv_id", "turn", named(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(earlier, itself)).alias("after"))
    results = conversations.filter(is_result).select(
        "conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op4(spark, sf_dir: str) -> DataFrame:
    return link(*stand_in(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
