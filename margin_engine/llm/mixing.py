"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

``sizes`` per document aggregate to one row per source (map-side partial
sums, so a hot source costs no more than any other).  Water-filling on that
catalogue-sized table: targets share the budget by weight; a source whose
share exceeds ``cap`` times its size stops there and the excess goes to the
others by weight, until none is above.  In closed form: order sources by
size / weight; those before the water line are clamped, the others get
weight * (budget - clamped) / (their weights).  All sums are exact integers;
one division gives the target.

Sampling: a source with target = r * size takes every document floor(r) times
whole, and the fractional repetition is a seeded systematic sample: documents
go by seeded hash to cells of about ``CELL`` documents of one source (a hot
source has many cells), and each cell, ordered by size and seeded hash, takes
evenly spaced ranks at rate frac(r) from a seeded start.  Taken words so
differ from the target by at most about one document a cell; no document is
taken more than ceil(r) <= cap times.  Same rows and seed, same mix.

Defined cases: null or empty texts have size 0 and are taken by the same
rule (0 words); a null source is a source (last in order); repeated rows are
rows of their own; if all sizes are 0 every target is 0; an empty table gives
an empty mix; other columns are carried unchanged by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
CAP = 2
CELL = 2048
SEED = 17


def text_size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT,
            cap: int = CAP) -> DataFrame:
    """(source, n_docs, source_size, weight, target) from rows (source, size).

    Sources are ranked by code point, null last, and weigh ``weights``, repeating.
    The windows run over one row per source (a catalogue, not documents)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     (rank % len(weights) + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", w)
    # clamped first: smaller size / weight reaches its cap at a lower water line
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(),
                           F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    per = (per.withColumn("total", F.sum("source_size").over(every))
           .withColumn("weights", F.sum("weight").over(every))
           .withColumn("done_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("done_weight", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # scaled by 100 to stay in integers: what is left for this and later sources
    left = F.expr(f"{percent} * total - {100 * cap} * done_size")
    free = F.col("weights") - F.col("done_weight")
    over = F.col("weight") * left > 100 * cap * F.col("source_size") * free
    per = per.withColumn("over", over).withColumn("left", left).withColumn("free", free)
    # the first source that is not over sets the water line for all that follow
    line = (per.withColumn("line_left", F.max(F.when(~F.col("over"), F.col("left"))).over(every))
            .withColumn("line_free", F.max(F.when(~F.col("over"), F.col("free"))).over(every)))
    target = F.when(F.col("over"), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("line_left")).cast("double")
        / (100 * F.col("line_free")).cast("double"))
    return line.select("source", "n_docs", "source_size", "weight",
                       F.coalesce(target, F.lit(0.0)).alias("target"))


def _digits(hexed: Column, n: int) -> Column:
    """The first n hexadecimal digits as a number."""
    return F.conv(F.substring(hexed, 1, n), 16, 10).cast("bigint")


def plan(rows: DataFrame, totals: DataFrame | None = None, seed: int = SEED, weights=WEIGHTS,
         percent: int = BUDGET_PERCENT, cap: int = CAP) -> DataFrame:
    """``rows`` (doc_id, source, size) with source_size, target and ``copies``.

    ``totals`` (source, size) are the rows that sizes are summed over, by default ``rows``; a column
    ``tie`` tells rows without doc_id apart."""
    t = targets(rows if totals is None else totals, weights, percent, cap)
    rows = rows.join(t.withColumnRenamed("source", "mix_source"),
                     F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = F.expr(f"greatest(1, (n_docs + {CELL - 1}) div {CELL})")
    rows = (rows.withColumn("mix_rate", rate)
            .withColumn("mix_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
                F.col("doc_id").cast("string"), F.col("tie") if "tie" in rows.columns else F.lit(""), F.lit("")))))
            .withColumn("mix_cell", _digits(F.col("mix_hash"), 7) % cells))
    w = Window.partitionBy("source", "mix_cell").orderBy("size", "mix_hash")
    k = F.row_number().over(w) - 1
    frac = F.col("mix_rate") - F.floor("mix_rate")
    start = _digits(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"),
                                   F.col("mix_cell").cast("string"))), 5) / F.lit(float(1 << 20))
    extra = F.floor((k + 1) * frac + start) - F.floor(k * frac + start)
    return (rows.withColumn("copies", (F.floor("mix_rate") + extra).cast("bigint"))
            .drop("mix_rate", "mix_hash", "mix_cell", "n_docs", "weight"))


def mix(df: DataFrame, key: str = "doc_id", text_col: str = "text", source: str = "source",
        **params) -> DataFrame:
    """The mixed documents: each row of ``df`` as often as the plan takes it, same columns.

    Every row has its own rank in the plan, repeated rows and rows without id too.  Only narrow rows (key, source,
    size, MD5 of the text) are planned; the copies of rows equal in these are summed, joined back and dealt out evenly among
    them, so no window sorts rows of different texts together."""
    # the row travels as one struct, so its columns may have any names
    sized = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(key).alias("doc_id"), F.col(source).alias("source"),
                      text_size(F.col(text_col)).alias("size"),
                      F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("tie"))
    p = (plan(sized.drop("whole"), **params).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("tie").alias("mix_tie"))
         .agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows")).filter("mix_copies > 0"))
    taken = sized.join(p, F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source"))
                       & (F.col("tie") == F.col("mix_tie")))
    alike = Window.partitionBy("mix_id", "mix_source", "mix_tie").orderBy(F.xxhash64("whole"))
    share = F.expr("mix_copies div mix_rows + if(place <= mix_copies % mix_rows, 1, 0)").cast("int")
    copies = (taken.withColumn("place", F.row_number().over(alike)).withColumn("share", share).filter("share > 0")
              .select("whole", F.explode(F.sequence(F.lit(1), F.col("share")))))
    return copies.select(*[F.col("whole").getField(c).alias(c) for c in df.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    return plan(sized).select("doc_id", "size", "source_size", "target",
                              (F.col("copies") * F.col("size")).alias("taken"))


_HEX = lambda h, n: " + ".join(
    f"CAST(instr('0123456789abcdef', substr({h}, {i + 1}, 1)) - 1 AS BIGINT) * {16 ** (n - 1 - i)}" for i in range(n))
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
ranked AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM per),
o AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(source_size) OVER w, 0) AS BIGINT) AS done_size, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS done_weight
  FROM ranked WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, {BUDGET_PERCENT} * total - {100 * CAP} * done_size AS remaining, weights - done_weight AS free FROM o),
c AS (SELECT *, weight * remaining > {100 * CAP} * source_size * free AS is_over FROM l),
t AS (SELECT source, n_docs, source_size, coalesce(CASE WHEN is_over THEN CAST({CAP} * source_size AS DOUBLE)
    ELSE CAST(weight * (max(remaining) FILTER (NOT is_over) OVER ()) AS DOUBLE)
       / CAST(100 * (max(free) FILTER (NOT is_over) OVER ()) AS DOUBLE) END, 0) AS target FROM c),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, greatest(1, (n_docs + {CELL - 1}) // {CELL}) AS cells
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, ({_HEX('h', 7)}) % cells AS cell FROM r),
y AS (SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size, h) - 1 AS k, rate - floor(rate) AS frac,
    md5('{SEED}:' || coalesce(source, '') || ':' || CAST(cell AS VARCHAR)) AS g FROM x)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) + floor((k + 1) * frac + ({_HEX('g', 5)}) / 1048576.0::DOUBLE) - floor(k * frac + ({_HEX('g', 5)}) / 1048576.0::DOUBLE) AS BIGINT) * size AS taken
FROM y"""
