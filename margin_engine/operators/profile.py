"""Data profiles: column profile, table profile, numeric summary and value
distributions of status / shop columns.

Column-wise statistics are computed by unpivoting to ``(column, value)`` and
aggregating once (map-side partial counts), so one shuffle serves every
column.  Per-column totals are tiny (one row per profiled column) and are
broadcast back; their size is bounded by the schema, not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import is_numeric_type, round_half_even
from ..functions.roles import find_columns, profile_role
from .quantiles import normalised, quantile_stats

STAT_DIGITS = 6
#: Distinct values that the sample of an approximate profile lets through, about.
SAMPLE_VALUES = 64
SAMPLE_SEED = 11


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _schema_frame(df: DataFrame, columns: Sequence[str], kind: str = "order") -> DataFrame:
    roles = profile_roles(columns, kind)
    rows = [(i, c, df.schema[c].dataType.simpleString(), roles.get(c))
            for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, role string")


def _unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
        for c in columns]))
    return df.select(pairs.alias("u")).select("u.column", "u.value")


def profile_roles(columns: Sequence[str], kind: str = "order") -> dict[str, str]:
    """Key role of each column: C1b for an order table (exclusive sku, amount,
    status, shop), C1a for a product table (potential SKU columns)."""
    if kind == "product":
        return {c: "sku" for c in find_columns(columns, K.KW_PROFILE_SKU)}
    return {c: role for c in columns if (role := profile_role(c))}


def column_profile(df: DataFrame, columns: Sequence[str] | None = None,
                   n_samples: int = 3, limit: int | None = None,
                   approximate: bool = False,
                   kind: str = "order") -> DataFrame:
    """Per column dtype, key role (C1b), null count, distinct non-null
    count and the ``n_samples`` smallest non-null values (as text).

    ``limit`` profiles only the first rows when given (the source profiled a
    100-row head); by default the whole table is profiled.  ``approximate``
    trades the exact distinct count (a shuffle of every (column, value)
    pair) for scans with HyperLogLog counts, exact null counts and values
    sampled by hash over all rows.
    """
    columns = list(columns or df.columns)
    src = df.limit(limit) if limit else df
    if approximate:
        return _column_profile_approx(src, columns, n_samples, kind)
    counts = (_unpivot_text(src, columns)
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    per_col = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
        .cast("long").alias("null_count"),
        F.count("value").alias("unique_count"))
    w = Window.partitionBy("column").orderBy(F.asc("value"))
    samples = (counts.filter(F.col("value").isNotNull())
               .withColumn("_rn", F.row_number().over(w))
               .filter(F.col("_rn") <= n_samples)
               .groupBy("column")
               .agg(F.sort_array(F.collect_list("value")).alias("sample_values")))
    meta = _schema_frame(df, columns, kind)
    return (meta.join(F.broadcast(per_col), "column", "left")
            .join(F.broadcast(samples), "column", "left")
            .select("position", "column", "dtype", "role",
                    F.coalesce("null_count", F.lit(0).cast("long")).alias("null_count"),
                    F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"),
                    F.coalesce("sample_values", F.array().cast("array<string>"))
                    .alias("sample_values")))


def _hash_of(c: str) -> Column:
    """A value's place in [0, 1) by hash: the same for its every occurrence."""
    return (F.xxhash64(F.lit(SAMPLE_SEED), _c(c).cast("string")).cast("double") / F.lit(float(1 << 64))) + F.lit(0.5)


def _column_profile_approx(df: DataFrame, columns: Sequence[str], n_samples: int, kind: str = "order") -> DataFrame:
    """Two scans without a shuffle of values: mergeable distinct sketches and exact null counts; then the values
    whose hash is below a threshold that some ``SAMPLE_VALUES`` distinct values of the column meet.

    A column whose threshold lets fewer than the wanted values through though it has more is looked at again with
    a four times higher one, so samples are distinct values drawn evenly from all rows."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count_if(_c(c).isNull()).alias(f"n{i}"), F.approx_count_distinct(_c(c).cast("string")).alias(f"d{i}")]
    one = df.agg(*aggs).first()
    share = {c: min(1.0, SAMPLE_VALUES / max(1, one[f"d{i}"])) for i, c in enumerate(columns)}
    samples = {}
    while share:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(_hash_of(c) < share[c], _c(c).cast("string")).alias("value"))
                                    for c in share]))
        met = df.select(cells.alias("u")).select("u.*").filter("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one"))
        w = Window.partitionBy("column").orderBy("value")
        rows = (met.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n_samples)
                .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect())  # a few values a column
        samples.update({r["column"]: r["v"] for r in rows})
        share = {c: min(1.0, 4 * t) for c, t in share.items() if t < 1.0 and len(samples.get(c, [])) < n_samples}
    stats = [(c, one[f"n{i}"], one[f"d{i}"], samples.get(c, [])) for i, c in enumerate(columns)]
    found = df.sparkSession.createDataFrame(stats, "column string, null_count long, unique_count long, sample_values array<string>")
    return (_schema_frame(df, columns, kind).join(F.broadcast(found), "column", "left")
            .select("position", "column", "dtype", "role", "null_count", "unique_count", "sample_values"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, names, types and null count per column (one pass)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(_c(c).isNull()).alias(f"__n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"__n{i}").alias("null_count"))
        for i, c in enumerate(cols)]))
    return one.select(F.col("__rows").alias("total_rows"), stacked.alias("s")).select(
        F.col("s.position").alias("position"), F.col("s.column").alias("column"),
        F.col("s.dtype").alias("dtype"), F.col("s.null_count").cast("long").alias("null_count"),
        F.col("total_rows").cast("long").alias("total_rows"),
        F.lit(len(cols)).alias("total_columns"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
                    approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, linear interpolation), max
    for every numeric column.

    Mean and standard deviation are rounded to ``STAT_DIGITS`` so the report
    does not depend on summation order.  ``approximate`` computes the
    quartiles with ``percentile_approx`` inside the same single pass (rank
    error at most n / ``accuracy``) instead of the exact selection, which takes two scans.
    """
    if approximate:
        return _numeric_summary_approx(df, list(columns or numeric_columns(df)),
                                       probabilities, accuracy)
    columns = list(columns or numeric_columns(df))
    spark = df.sparkSession
    qnames = [f"p{int(round(p * 100))}" for p in probabilities]
    schema = ", ".join(["column string, count long, mean double, std double, min double", *[f"{q} double" for q in qnames], "max double"])
    if not columns:
        return spark.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(columns):
        v = normalised(_c(c))
        aggs += [round_half_even(F.avg(v), STAT_DIGITS).alias(f"a{i}"), round_half_even(F.stddev_samp(v), STAT_DIGITS).alias(f"s{i}")]
    row, values = quantile_stats(df, columns, probabilities, aggs)
    out = [(c, row[f"n{i}"], row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"], *[values[(c, p)] for p in probabilities], row[f"hi{i}"])
           for i, c in enumerate(columns)]  # one row per profiled column
    rounded = [round_half_even(F.col(q), STAT_DIGITS).alias(q) for q in qnames]
    return spark.createDataFrame(out, schema).select("column", "count", "mean", "std", "min", *rounded, "max")


def _numeric_summary_approx(df: DataFrame, columns: Sequence[str],
                            probabilities: Sequence[float], accuracy: int) -> DataFrame:
    qnames = [f"p{int(round(p * 100))}" for p in probabilities]
    parts = []
    for c in columns:
        v = normalised(_c(c))
        q = F.percentile_approx(v, list(probabilities), accuracy)
        parts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"),
                              F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                              F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max")))
    row = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    long = row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(parts))]))
                      .alias("s")).select("s.*")
    return long.select("column", F.col("count").cast("long").alias("count"),
                       round_half_even(F.col("mean"), STAT_DIGITS).alias("mean"),
                       round_half_even(F.col("std"), STAT_DIGITS).alias("std"), "min",
                       *[F.col("q")[i].alias(n) for i, n in enumerate(qnames)], "max")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    counts = (_unpivot_text(df, columns)
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    totals = counts.groupBy("column").agg(F.sum("count").cast("long").alias("total_records"),
                                          F.count("value").alias("distinct_values"))
    return counts.filter(F.col("value").isNotNull()), totals


def status_counts(orders: DataFrame) -> DataFrame:
    """Count per value of every status column, with the table's row count."""
    cols = find_columns(orders.columns, K.KW_STATUS)
    if not cols:
        return orders.sparkSession.createDataFrame(
            [], "column string, value string, count long, total_records long")
    counts, totals = _value_counts(orders, cols)
    return (counts.join(F.broadcast(totals), "column")
            .select("column", "value", F.col("count").cast("long").alias("count"),
                    "total_records"))


def shop_counts(orders: DataFrame) -> DataFrame:
    """Count per value of every shop column, distinct count and row count."""
    cols = find_columns(orders.columns, K.KW_SHOP_PROFILE)
    if not cols:
        return orders.sparkSession.createDataFrame(
            [], "column string, value string, count long, total_shops long, total_orders long")
    counts, totals = _value_counts(orders, cols)
    return (counts.join(F.broadcast(totals), "column")
            .select("column", "value", F.col("count").cast("long").alias("count"),
                    F.col("distinct_values").cast("long").alias("total_shops"),
                    F.col("total_records").alias("total_orders")))

