"""Conversation structure repair: cheapest edits, ties by the least audit string.

A conversation's rows, in order, are edited until their role initials read ``(s?(ua)+)?``: Keep costs 0,
Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; a row that stays though truncated adds
1; blank and duplicate rows must go.  The audit is the edits' initials; of the cheapest, the ASCII-least.

Nodes are (row i, state of the role grammar); arcs are edits.  The grammar's next role is fixed by its state, so an
edit letter leads from a node to one node at most.

1. Ranks of rows within conversations come from a deal by range (``ranks.ranked``).  Rows are cut into blocks of ``BLOCK``
   consecutive rows; a block is the unit of memory, and a conversation of any length is many blocks.
2. Cost DP, backwards: the cost from each node to the end.  A conversation of several blocks first gives a 4 x 4 cost matrix a block; a
   stream over its blocks, last first, turns these into the costs at each block's end (four numbers are kept).
3. Optimal arcs are those that keep the cost.  In a block the nodes on them are ranked by the audit strings that start at them, of length
   1, 2, 4, ...: a node's rank of length 2m is the rank of the pair (its rank of length m, the rank of length m of the node m arcs on), and the
   pointers double likewise.  The arc to the least (letter, rank) is the least path's; the doubled pointers list its nodes.
   Every state at a block's start gives an audit part and the state at its end.
4. A stream over each conversation's blocks and texts joins the parts from the start state and hashes the repaired rows.

The last stream is in order within a conversation, as one SHA-256 over all its rows asks; it keeps one batch and the audit, which is
one cell of the result, so the longest conversation has as many rows as a cell has characters (2^31).

Defined cases: null roles and texts count as one space; a row whose role begins with none of s, u, a (an empty role
too) cannot be kept as it is; rows of one turn are ordered by role, then text by its MD5; a null conv_id is a conversation; no rows after
damage give zeros, an empty audit and the hash of the empty string; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .merkle import crc32_sql
from .ranks import ranked

BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
#: States of the role grammar: nothing yet, after s, after u, after a.
_START, _S, _U, _A = range(4)
#: The state after a row of this role initial (s, u, a, any other), -1: not allowed.
_AFTER = np.array([[_S, _U, -1, -1], [-1, _U, -1, -1], [-1, -1, _A, -1], [-1, _U, -1, -1]])
#: The state after a reroled or inserted row, and that row's role.
_NEXT = np.array([_U, _U, _A, _U])
ROLE_OF = ("user", "user", "assistant", "user")
_FAR = np.int64(1) << 40
#: Cost from a state to another by inserts alone, and from a state to a legal end.
_BY_INSERT = np.array([[0, _FAR, 2, 4], [_FAR, 0, 2, 4], [_FAR, _FAR, 0, 2], [_FAR, _FAR, 2, 0]])
_END = np.array([0, 4, 2, 0], dtype=np.int64)
_SPACES = "".join(map(chr, (0x20, *range(9, 14))))

ROWS_IN = ["conv_key", "block", "pos", "initial", "forced", "truncated"]
SUMMARY = "conv_key string, block bigint, costs array<bigint>"
ENDS = "conv_key string, block bigint, ends array<bigint>"
PARTS = "conv_key string, block bigint, cost array<bigint>, exits array<bigint>, audits array<string>, first bigint, last bigint, illegal bigint"


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 picks."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    return (rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
            .withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


# ------------------------------------------------------------------ inside a task

def _whole_groups(batches, keys: int):
    """Regroup sorted batches so that no group (equal first ``keys`` columns) is cut; yields tables with group starts."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        start = _group_starts(table, keys)
        cut = int(start[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks(), start[:-1]
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _group_starts(held, keys)


def _group_starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for i in range(keys):
        code = table.column(i).combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _pieces(starts: np.ndarray, rows: int, most: int = 16 * BLOCK):
    """Cut a run of groups into pieces of about ``most`` rows (at least one group)."""
    ends = np.append(starts[1:], rows)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, side="right")))
        yield i, j
        i = j


class _Blocks:
    """Rows of several blocks as arrays: the role's code (s, u, a, other), whether it must go, whether it is truncated."""

    def __init__(self, code, forced, truncated, starts):
        self.code, self.forced, self.cut, self.starts = code, forced, truncated.astype(np.int64), starts
        self.ends = np.append(starts[1:], len(code))
        self.by_length = np.argsort(self.starts - self.ends, kind="stable")
        self.lengths = (self.ends - self.starts)[self.by_length]

    def _row_costs(self, rows, after):
        """Cost from each state before these rows, given ``after`` (rows, 4, ...) behind them, without inserts."""
        shape = (len(rows),) + (1,) * (after.ndim - 2)
        cut, forced = self.cut[rows].reshape(shape), self.forced[rows].reshape(shape)
        out = np.empty_like(after)
        for q in range(4):
            best = after[:, q] + DELETE
            stay = after[:, _NEXT[q]] + REROLE + cut
            kept_to = _AFTER[q][self.code[rows]]
            kept = after[np.arange(len(rows)), np.maximum(kept_to, 0)] + cut
            kept = np.where((kept_to >= 0).reshape(shape), kept, _FAR)
            out[:, q] = np.where(forced, best, np.minimum(best, np.minimum(stay, kept)))
        return out

    @staticmethod
    def _with_inserts(costs):
        out = costs.copy()
        for q in range(4):
            for r in range(4):
                if r != q and _BY_INSERT[q, r] < _FAR:
                    out[:, q] = np.minimum(out[:, q], costs[:, r] + _BY_INSERT[q, r])
        return out

    def backward(self, at_end, keep: bool):
        """Costs at each block's start, and with ``keep`` at every row, given the costs at its end; all blocks step together."""
        now = at_end.copy()
        every = np.empty((len(self.code), *now.shape[1:]), dtype=np.int64) if keep else None
        for step in range(int(self.lengths[0]) if len(self.lengths) else 0):
            live = self.by_length[:int(np.searchsorted(-self.lengths, -step, side="left"))]
            rows = self.ends[live] - 1 - step
            now[live] = self._with_inserts(self._row_costs(rows, now[live]))
            if keep:
                every[rows] = now[live]
        return now, every

    def least_paths(self, at_end):
        """(costs, exit states, audit parts) of each block and state at its start."""
        n, blocks = len(self.code), len(self.starts)
        first, cost = self.backward(at_end, True)
        # node 4 * row + state, then the exits 4 * (rows + block) + state
        block = np.repeat(np.arange(blocks), self.ends - self.starts)
        row = np.arange(n)
        is_last = row == self.ends[block] - 1
        behind = np.where(is_last, n + block, row + 1)
        reach = np.concatenate([cost, at_end]).reshape(-1)
        nodes = 4 * (n + blocks)
        heads, letters, tails, prices = [], [], [], []
        for q in range(4):
            here = 4 * row + q
            kept_to = _AFTER[q][self.code]
            keeps = (kept_to >= 0) & ~self.forced
            for letter, ok, to, price in (
                    (0, np.ones(n, bool), 4 * behind + q, np.full(n, DELETE)),
                    (1, np.ones(n, bool), 4 * row + _NEXT[q], np.full(n, INSERT)),
                    (2, keeps, 4 * behind + kept_to, self.cut),
                    (3, ~self.forced, 4 * behind + _NEXT[q], REROLE + self.cut)):
                tight = ok.copy()
                tight[ok] = reach[to[ok]] + price[ok] == reach[here[ok]]
                heads.append(here[tight]), letters.append(np.full(tight.sum(), letter)), tails.append(to[tight]), prices.append(price[tight])
        head, letter, tail = np.concatenate(heads), np.concatenate(letters), np.concatenate(tails)
        # length 1: the least letter; its arc is the pointer (a letter has one target)
        rank, point = np.zeros(nodes, dtype=np.int64), np.arange(nodes)
        order = np.lexsort((letter, head))[::-1]
        rank[head[order]] = letter[order] + 1  # the last write is the least letter; exits keep 0
        point[head[order]] = tail[order]
        pointers = [point]
        while True:
            on = pointers[-1][pointers[-1]]
            _, new = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)
            new = new.reshape(-1)
            done = np.array_equal(on, pointers[-1])
            rank = new
            if done:
                break
            pointers.append(on)
        # the ranks choose among a node's optimal arcs: least (letter, rank of the node behind)
        order = np.lexsort((rank[tail], letter, head))[::-1]
        chosen, said = np.arange(nodes), np.zeros(nodes, dtype=np.int64)
        chosen[head[order]], said[head[order]] = tail[order], letter[order]
        doubled, steps = [chosen], [(chosen != np.arange(nodes)).astype(np.int64)]
        while len(doubled) < len(pointers):
            p, s = doubled[-1], steps[-1]
            doubled.append(p[p]), steps.append(s + s[p])
        begin = (4 * self.starts[:, None] + np.arange(4)).reshape(-1)
        length = steps[-1][begin]
        exits = doubled[-1][begin] % 4
        k = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(begin, length)
        for bit, p in enumerate(doubled):
            step = (k >> bit) & 1 == 1
            at[step] = p[at[step]]
        audit = LETTERS[said[at]].tobytes().decode()
        bounds = np.append(0, np.cumsum(length))
        return first, exits.reshape(-1, 4), [audit[a:b] for a, b in zip(bounds[:-1], bounds[1:])]



def _arrays(table: pa.Table, i: int, j: int, starts: np.ndarray, rows: int):
    a, b = int(starts[i]), int(starts[j]) if j < len(starts) else rows
    get = lambda name: table.column(name).slice(a, b - a).to_numpy(zero_copy_only=False)
    return get, starts[i:j] - a


def _load(get, starts):
    return _Blocks(get("initial").astype(np.int64), get("forced").astype(bool), get("truncated").astype(bool), starts)


def summaries(batches):
    """A 4 x 4 matrix a block: cost from each state at its start to each at its end."""
    for table, starts in _whole_groups(batches, 2):
        for i, j in _pieces(starts, table.num_rows):
            get, own = _arrays(table, i, j, starts, table.num_rows)
            b = _load(get, own)
            ends = np.full((len(own), 4, 4), _FAR)
            ends[:, range(4), range(4)] = 0
            costs, _ = b.backward(ends, False)
            at = pa.array(starts[i:j])
            yield pa.RecordBatch.from_arrays([table.column("conv_key").take(at).combine_chunks(), table.column("block").take(at).combine_chunks(),
                                              pa.array(list(np.minimum(costs, _FAR).reshape(-1, 16)), pa.list_(pa.int64()))], names=["conv_key", "block", "costs"])


def block_ends(batches):
    """Costs at the end of each block, from blocks sorted last first within their conversation."""
    conv, now = object(), None
    for batch in batches:
        out = []
        for key, block, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "block", "costs"))):
            if key != conv:
                conv, now = key, _END
            out.append((key, block, now.tolist()))
            now = np.minimum((np.array(costs).reshape(4, 4) + now).min(axis=1), _FAR)
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["conv_key", "block", "ends"])


def block_paths(batches):
    """Costs, exit states, audit parts and illegal pairs of each block; a block may lead with a row that holds its end's costs."""
    for table, starts in _whole_groups(batches, 2):
        for i, j in _pieces(starts, table.num_rows):
            get, own = _arrays(table, i, j, starts, table.num_rows)
            pos = get("pos")
            head = pos < 0
            ends = np.tile(_END, (len(own), 1))
            group = np.searchsorted(own, np.arange(len(pos)), side="right") - 1
            a = int(starts[i])
            for k in np.flatnonzero(head):
                ends[group[k]] = table.column("ends")[a + int(k)].as_py()
            keep = ~head
            rows_before = np.append(0, np.cumsum(keep))
            real = lambda name: get(name)[keep]
            b = _load(real, rows_before[own])
            cost, exits, audits = b.least_paths(ends)
            pair = b.code
            legal = ((pair[:-1] == 0) & (pair[1:] == 1)) | ((pair[:-1] == 1) & (pair[1:] == 2)) | ((pair[:-1] == 2) & (pair[1:] == 1))
            inside = np.ones(max(len(pair) - 1, 0), bool)
            inside[b.starts[1:] - 1] = False
            wrong = np.append(0, np.cumsum(inside & ~legal))
            illegal = wrong[np.maximum(b.ends - 1, 0)] - wrong[b.starts]
            at = pa.array(starts[i:j])
            yield pa.RecordBatch.from_arrays(
                [table.column("conv_key").take(at).combine_chunks(), table.column("block").take(at).combine_chunks(),
                 pa.array(list(cost), pa.list_(pa.int64())), pa.array(list(exits.astype(np.int64)), pa.list_(pa.int64())),
                 pa.array([audits[4 * x:4 * x + 4] for x in range(len(own))], pa.list_(pa.string())),
                 pa.array(pair[b.starts].astype(np.int64)), pa.array(pair[b.ends - 1].astype(np.int64)), pa.array(illegal.astype(np.int64))],
                names=["conv_key", "block", "cost", "exits", "audits", "first", "last", "illegal"])


def _end_inserts(state: int):
    """Inserts that end a conversation in this state, and the roles they add."""
    roles = []
    while state not in (_START, _A):
        roles.append(ROLE_OF[state])
        state = int(_NEXT[state])
    return roles


class _Repair:
    """One conversation of the last stream."""

    def __init__(self):
        self.state, self.parts, self.cost, self.illegal, self.last = _START, [], None, 0, None
        self.hash, self.any, self.letters, self.at = hashlib.sha256(), False, "", 0

    def block(self, cost, exits, audits, first, last, illegal):
        if self.cost is None:
            self.cost = cost[_START]
        elif (self.last, first) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.illegal, self.last = self.illegal + illegal, last
        self.letters, self.at = audits[self.path_state()], 0
        self.parts.append(self.letters)
        self.to = exits[self.entered]

    def path_state(self):
        self.entered = self.state
        return self.state

    def _write(self, role, text):
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def row(self, initial, role, text):
        """Take the edits up to and including this row's."""
        while True:
            letter = self.letters[self.at]
            self.at += 1
            if letter == "D":
                return
            if letter == "K":
                self._write(role, text)
                self.state = int(_AFTER[self.state, initial])
                return
            self._write(ROLE_OF[self.state], "" if letter == "I" else text)
            self.state = int(_NEXT[self.state])
            if letter == "R":
                return

    def close(self):
        for role in _end_inserts(self.state):
            self._write(role, "")
            self.parts.append("I")
        return self.cost, self.illegal, "".join(self.parts), self.hash.hexdigest()


RESULT = "conv_key string, cost bigint, illegal bigint, audit string, repaired_sha256 string"


def assemble(batches):
    """Result rows from a stream of each conversation's rows in order, each block led by its paths."""
    key, now, out = None, None, []

    def flush():
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["conv_key", "cost", "illegal", "audit", "repaired_sha256"])
        out.clear()
        return batch

    for batch in batches:
        lists = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for k, conv in enumerate(lists["conv_key"]):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, *now.close()))
                key, now = conv, _Repair()
            if lists["lead"][k] == 0:
                now.block(*(lists[c][k] for c in ("cost", "exits", "audits", "first", "last", "illegal")))
            else:
                now.row(lists["initial"][k], lists["role"][k], lists["text"][k])
        yield flush()
    if now is not None:
        out.append((key, *now.close()))
        yield flush()


# ------------------------------------------------------------------ the job

def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; role and text not null): gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    visible = F.rtrim("text", F.lit(_SPACES))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    rows = rows.select(
        F.coalesce(F.concat(F.lit("."), F.col("conv_id").cast("string")), F.lit("")).alias("conv_key"), "turn", "role", "text",
        F.md5(F.col("text").cast("binary")).alias("text_md5"), F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256).alias("said"),
        initial.alias("initial"), (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("open_end"))
    r = ranked(rows, "conv_key", ["turn", "role", "text_md5"], "conv-ranks")
    firsts = r.filter("not blank").groupBy("conv_key", "said").agg(F.min("rank").alias("first_rank")).select(
        F.col("conv_key").alias("f_key"), "first_rank")
    narrow = (r.drop("text", "role", "text_md5", "said")
              .join(firsts, (F.col("conv_key") == F.col("f_key")) & (F.col("rank") == F.col("first_rank")), "left")
              .withColumn("duplicate", ~F.col("blank") & F.col("f_key").isNull())
              .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open_end")))
    narrow = materialize(narrow.select("conv_key", F.expr(f"rank div {block}").alias("block"), F.col("rank").alias("pos"), "initial",
                                       (F.col("blank") | F.col("duplicate")).alias("forced"), "truncated", "blank", "duplicate", "turn",
                                       F.col("size").alias("n")), "conv-rows")
    counts = narrow.groupBy("conv_key").agg(
        F.max("turn").alias("hi"), F.min("turn").alias("lo"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")])
    # distinct turns in two steps: a conversation of a third of all rows is spread over its turns
    turns = narrow.groupBy("conv_key", "turn").agg(F.lit(1).alias("one")).groupBy("conv_key").agg(F.count("turn").alias("turns"))
    many = narrow.filter(F.col("n") > block)
    order = ["conv_key", "block", "pos"]
    sums = materialize(many.select(*ROWS_IN).repartition("conv_key", "block").sortWithinPartitions(*order).mapInArrow(summaries, SUMMARY), "conv-blocks")
    ends = (sums.repartition("conv_key").sortWithinPartitions("conv_key", F.col("block").desc()).mapInArrow(block_ends, ENDS)
            .select("conv_key", "block", F.lit(-1).cast("bigint").alias("pos"), F.lit(3).alias("initial"), F.lit(False).alias("forced"), F.lit(False).alias("truncated"), "ends"))
    own = narrow.select(*ROWS_IN, F.lit(None).cast("array<bigint>").alias("ends"))
    paths = own.union(ends).repartition("conv_key", "block").sortWithinPartitions(*order).mapInArrow(block_paths, PARTS)
    no = lambda kind: F.lit(None).cast(kind)
    texts = r.select("conv_key", F.col("rank").alias("pos"), F.lit(1).alias("lead"), "initial", "role", "text", no("array<bigint>").alias("cost"),
                     no("array<bigint>").alias("exits"), no("array<string>").alias("audits"), *[no("bigint").alias(c) for c in ("first", "last", "illegal")])
    leads = paths.select("conv_key", (F.col("block") * block).alias("pos"), F.lit(0).alias("lead"), F.lit(3).alias("initial"), no("string").alias("role"),
                         no("string").alias("text"), "cost", "exits", "audits", "first", "last", "illegal")
    whole = texts.union(leads).repartition("conv_key").sortWithinPartitions("conv_key", "pos", "lead").mapInArrow(assemble, RESULT)
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    return (whole.join(counts, "conv_key").join(turns, "conv_key")
            .select(F.expr("cast(if(conv_key = '', null, substring(conv_key, 2)) as bigint)").alias("conv_id"), gaps.alias("gaps"),
                    "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def with_empty(result: DataFrame, conversations: DataFrame) -> DataFrame:
    """``result`` with a row for every conversation that has no rows left."""
    ids = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(result, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return with_empty(repair(damage(rows)), rows)


def _sql() -> str:
    """DuckDB: the same edits by a forward recursion that keeps the least (cost, audit) of each row and state."""
    inserts, edits, ends = [], [], []
    for q in range(4):
        state, letters, lines = q, "", []
        for k in range(3):
            inserts.append(f"({q}, {state}, {INSERT * k}, '{letters}', CAST({lines} AS VARCHAR[]))")
            if state in (_START, _A):
                ends.append(f"({q}, {INSERT * k}, '{letters}', CAST({lines} AS VARCHAR[]))")
            lines = lines + [f"{ROLE_OF[state]}:"]
            state, letters = int(_NEXT[state]), letters + "I"
        edits.append(f"({q}, {q}, 'D', NULL, NULL)")
        edits.append(f"({q}, {_NEXT[q]}, 'R', NULL, '{ROLE_OF[q]}')")
        edits += [f"({q}, {_AFTER[q][c]}, 'K', '{x}', NULL)" for c, x in enumerate("sua") if _AFTER[q][c] >= 0]
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    hit = crc32_sql(f"{text('conv_id')} || ':' || {text('turn')}")
    return f"""
WITH RECURSIVE ins(q, q1, ins_cost, ins_audit, ins_rows) AS (VALUES {', '.join(inserts)}),
edit(q1, q2, letter, needs, as_role) AS (VALUES {', '.join(edits)}),
done(q, end_cost, end_audit, end_rows) AS (VALUES {', '.join(ends)}),
h AS (SELECT conv_id, turn, {text('role')} AS role, {text('text')} AS text, {hit} % 20 AS hit FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS i FROM d),
s AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open_end, left(role, 1) AS a,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
r AS (SELECT *, NOT blank AND seen AS dup, NOT blank AND NOT seen AND open_end AS cut, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM s),
f(c, i, q, best) AS (SELECT DISTINCT c, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM r
  UNION ALL SELECT f.c, f.i + 1, q2, min({{'cost': CAST(best.cost + ins_cost + CASE letter WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END
        + CASE WHEN letter <> 'D' AND cut THEN {TRUNCATED} ELSE 0 END AS BIGINT), 'audit': best.audit || ins_audit || letter,
      'lines': list_concat(best.lines, ins_rows, CASE WHEN letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(as_role, role) || ':' || text] END)}})
    FROM f JOIN r ON r.c = f.c AND r.i = f.i JOIN ins ON ins.q = f.q JOIN edit ON edit.q1 = ins.q1
    WHERE letter = 'D' OR (NOT blank AND NOT dup AND (letter = 'R' OR needs = a)) GROUP BY f.c, f.i + 1, q2),
n AS (SELECT conv_id, c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (b IS NOT NULL AND a || b NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id, c),
e AS (SELECT f.c, min({{'cost': best.cost + end_cost, 'audit': best.audit || end_audit, 'lines': list_concat(best.lines, end_rows)}}) AS best
  FROM f JOIN n ON n.c = f.c AND n.n = f.i JOIN done ON done.q = f.q GROUP BY f.c),
x AS (SELECT DISTINCT conv_id FROM conversations)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(cut, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM x LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN e ON e.c = n.c"""


OP13_SQL = _sql()
