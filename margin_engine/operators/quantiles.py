"""Exact quantiles (linear interpolation between order statistics) in a few plain scans.

1. One aggregation gives every column's count, minimum and maximum; a caller's own statistics ride along.
2. A histogram scan counts ``accuracy`` bins of equal width a column, with each bin's least and greatest value.  The counts say
   exactly which bin holds a wanted rank, so the rank lies between that bin's least and greatest value.  A bin
   with one distinct value, or with few of the column's values, is done; the others are cut again, at most
   ``ROUNDS`` times.
3. One filtered scan counts, per column, the values below, between and inside these intervals; only
   values inside travel one by one (a group per distinct value, partial counts first), about
   12 n / ``accuracy`` a rank.  They are saved, and running sums over one interval find the ranks exactly.

Cells are laid out as (place, value) pairs and meet their bounds in small arrays by place, so the work for a cell
is the same few instructions whatever the number of columns.  The counts of the last scan prove that a rank lies
in its interval; should the table have changed between scans, the columns concerned are done again.  The driver sees
one row a wanted rank, counts per interval and the selected values only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

ACCURACY = 10_000
#: A final interval holds at most 4 * MARGIN / accuracy of its column's values, or one distinct value.
MARGIN = 3
ROUNDS = 6
LEAST_BINS = 1000
_LARGEST = 1.7976931348623157e308


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def normalised(v: Column) -> Column:
    """-0.0 and 0.0 are one value; NaN counts as missing."""
    d = v.cast("double")
    return F.when(F.isnan(d), F.lit(None)).when(d == F.lit(0.0), F.lit(0.0)).otherwise(d)


def _ranks(n: int, probabilities: Sequence[float]) -> list[int]:
    return sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)})


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, v): the cells that are not missing, with the place of their column in ``columns``."""
    return df.select(F.posexplode(F.array(*[normalised(_c(c)) for c in columns])).alias("pos", "v")).filter("v is not null")


def _by_place(values: Sequence[float | None]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("pos"))


def _half(x: float) -> float:
    """Half a finite stand-in, so that a difference of two never overflows."""
    return max(-_LARGEST, min(_LARGEST, x)) / 2


def _cut(df: DataFrame, parts: list[tuple], bins: int) -> list[tuple]:
    """Cuts intervals (column, least, greatest, values below, ranks, count) into bins: those that hold the ranks, likewise."""
    columns = [p[0] for p in parts]
    low, high = _by_place([p[1] for p in parts]), _by_place([p[2] for p in parts])
    half = F.greatest(F.least(F.col("v"), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2
    share = (half - _by_place([_half(p[1]) for p in parts])) / _by_place([_half(p[2]) - _half(p[1]) for p in parts])
    bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("bigint")
    # rounding keeps the order of values, so bins hold consecutive values
    counted = (_cells(df, columns).filter((F.col("v") >= low) & (F.col("v") <= high))
               .groupBy((F.col("pos").cast("bigint") * bins + bin_).alias("key"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
               .withColumn("pos", F.floor(F.col("key") / bins).cast("int")))
    before = F.sum("n").over(Window.partitionBy("pos").orderBy("key")) - F.col("n")  # at most ``bins`` rows a column
    wanted = F.get(F.array(*[F.array(*[F.lit(r - p[3]).cast("bigint") for r in p[4]]) for p in parts]), F.col("pos"))
    met = counted.withColumn("before", before).filter(
        F.exists(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
    out = []
    for r in met.collect():  # at most one row a wanted rank
        column, _, _, base, ranks, _ = parts[r["pos"]]
        below = base + r["before"]
        out.append((column, r["a"], r["b"], below, [x for x in ranks if below <= x < below + r["n"]], r["n"]))
    return out


def _sketch(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], margin: float, accuracy: int, more: Sequence[Column]):
    """(row of ``more`` and the plain statistics, per column: count and the disjoint intervals that hold its wanted ranks)."""
    aggs = list(more)
    for i, c in enumerate(columns):
        v = normalised(_c(c))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    size = {c: row[f"n{i}"] for i, c in enumerate(columns) if row[f"n{i}"]}
    done = {c: [] for c in size}
    todo = [(c, row[f"lo{i}"], row[f"hi{i}"], 0, _ranks(size[c], probabilities), size[c]) for i, c in enumerate(columns) if c in size]
    for left in range(ROUNDS, -1, -1):
        again = []
        for part in todo:
            column, a, b, _, _, n = part
            small = n <= 4 * margin * size[column] / accuracy
            if left == 0 or small or _half(a) == _half(b):
                done[column].append((a, b))
            else:
                again.append(part)
        if not again:
            break
        todo = _cut(df, again, max(LEAST_BINS, accuracy))
    return row, {c: (size[c], sorted(done[c])) for c in size}


def _select(df: DataFrame, found: dict, ranks: dict) -> tuple[dict, list[str]]:
    """The last scan: {(column, rank): value} and the columns with a rank outside its interval."""
    columns = list(found)
    most = max(len(intervals) for _, intervals in found.values())
    region = F.lit(0)  # 2j: below interval j (above the one before); 2j + 1: inside it; the last even number: above all
    for j in range(most):
        ends = [intervals[j] if j < len(intervals) else (None, None) for _, intervals in found.values()]
        a, b = _by_place([x[0] for x in ends]), _by_place([x[1] for x in ends])
        region = region + F.when(F.col("v") > b, 2).when(F.col("v") >= a, 1).otherwise(0)
    cells = _cells(df, columns).withColumn("region", region)
    inside = F.col("region") % 2 == 1
    counted = materialize(cells.groupBy("pos", "region", F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")), "quantiles")
    totals = {(columns[r["pos"]], r["region"]): r["n"] for r in counted.groupBy("pos", "region").agg(F.sum("n").alias("n")).collect()}
    hit, wrong = F.lit(False), []
    for c, wanted in ranks.items():
        below = 0
        left = set(wanted)
        for k in range(2 * len(found[c][1]) + 1):
            n = totals.get((c, k), 0)
            for r in [r for r in left if r < below + n]:
                left.discard(r)
                if k % 2 == 0:
                    wrong.append(c)
                else:
                    hit |= ((F.col("pos") == columns.index(c)) & (F.col("region") == k)
                            & (F.col("before") <= r - below) & (r - below < F.col("before") + F.col("n")))
            below += n
    order = Window.partitionBy("pos", "region").orderBy("v")
    ranked = counted.filter(inside).withColumn("before", F.sum("n").over(order) - F.col("n"))
    rows = ranked.filter(hit).select("pos", "region", "v", "before", "n").collect()  # at most one row a rank
    out = {}
    for r in rows:
        c = columns[r["pos"]]
        base = sum(totals.get((c, k), 0) for k in range(r["region"])) + r["before"]
        for rank in ranks[c]:
            if base <= rank < base + r["n"]:
                out[(c, rank)] = r["v"]
    return out, sorted(set(wrong))


def quantile_stats(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], more: Sequence[Column] = (),
                   accuracy: int = ACCURACY):
    """(row of ``more`` and the plain statistics, {(column, p): exact quantile or None})."""
    row, found = _sketch(df, columns, probabilities, MARGIN, accuracy, more)
    place = {c: {p: p * (found[c][0] - 1) for p in probabilities} for c in found}
    ranks = {c: _ranks(found[c][0], probabilities) for c in found}
    at, margin, todo = {}, MARGIN, dict(found)
    while todo:
        got, wrong = _select(df, todo, {c: ranks[c] for c in todo})
        at.update(got)
        margin *= 4
        todo = _sketch(df, wrong, probabilities, margin, accuracy, ())[1] if wrong else {}
    out = {}
    for c in columns:
        for p in probabilities:
            if c not in found:
                out[(c, p)] = None
                continue
            x = place[c][p]
            a, b = at[(c, math.floor(x))], at[(c, math.ceil(x))]
            out[(c, p)] = a if a == b else a + (b - a) * (x - math.floor(x))
    return row, out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Rows ``(column, p, value)``: exact quantiles with linear interpolation
    at position ``p * (n - 1)`` over the non-null values; null when empty."""
    _, values = quantile_stats(df, columns, probabilities, accuracy=accuracy)
    return df.sparkSession.createDataFrame([(c, float(p), values[(c, p)]) for c in columns for p in probabilities],
                                           "column string, p double, value double")
