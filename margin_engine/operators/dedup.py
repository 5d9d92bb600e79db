"""Deduplication operators and duplicate statistics.

"First" needs an order: a file's row order is not a Spark concept, so every
keep-first operator takes explicit ``order_by`` columns and breaks remaining
ties with all other (orderable) columns, ascending, nulls first.  After an
exact dedup, whole rows are unique, so that order is total and the result
is deterministic whatever the partitioning.

Scale notes
-----------
* Exact dedup is a hash aggregate over all columns: copies collapse in the
  map-side partial aggregate before the shuffle, so a group of copies that
  holds a third of the table costs one row per map task on the wire.
* Keep-first per key is ``row_number() == 1`` over the key window.  Spark
  plans it with a partial ``WindowGroupLimit`` under the shuffle, which keeps
  one row per key per map task before anything is exchanged, so a hot key
  does not land whole in one task.
* Reports only count, so they group by a row's fingerprint (MD5 of an injective text of the
  row, 16 bytes) and an independent 64-bit hash that tells rows of one MD5 apart: 24 bytes a
  row travel, whatever the row's width, and copies collapse before that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_half_even


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or type(dt).__name__ == "VariantType":
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def row_order(df: DataFrame, order_by: Sequence[str] | None = None,
              exclude: Sequence[str] = (), value: Callable[[str], Column] = _c) -> list[Column]:
    """Sort expressions: ``order_by`` first, then every other orderable column."""
    first = list(order_by or [])
    rest = [f.name for f in df.schema.fields
            if f.name not in first and f.name not in exclude and _orderable(f.dataType)]
    return [value(c).asc_nulls_first() for c in first + rest]


def exact_dedup(df: DataFrame, keep_first_by: Sequence[str] | None = None) -> DataFrame:
    """Drop fully identical rows (nulls compare equal).

    ``keep_first_by`` names ordering columns (e.g. a file-position column)
    that are not part of the row's identity: rows equal on every other
    column are copies, and the copy with the smallest ordering value stays.
    """
    order = [c for c in (keep_first_by or []) if c in df.columns]
    if not order:
        return df.dropDuplicates()
    data = [c for c in df.columns if c not in order]
    if len(order) == 1:
        first = F.min(_c(order[0])).alias(order[0])
        return df.groupBy(*[_c(c) for c in data]).agg(first).select(*[_c(c) for c in df.columns])
    packed = F.min(F.struct(*[_c(c) for c in order])).alias("__o")
    return (df.groupBy(*[_c(c) for c in data]).agg(packed)
            .select(*[_c(c) for c in data], *[F.col(f"__o.`{c}`").alias(c) for c in order])
            .select(*[_c(c) for c in df.columns]))


def first_per_key(df: DataFrame, keys: Sequence[str],
                  order_by: Sequence[str] | None = None, value: Callable[[str], Column] = _c,
                  then: Sequence[Column] = ()) -> DataFrame:
    """First row per key combination by the given order.

    Null key values group together.  The window is partitioned by the *tuple*
    of the keys: the operator always gets its own exchange with the partial
    group limit below it (instead of inheriting a partitioning on a subset of
    the keys), and its output is not partitioned on the bare key, so a later
    shuffle join on the key sees a direct shuffle on this side.  ``value`` gives what a column is
    grouped and ordered by, ``then`` what decides after all columns.
    """
    if not keys:
        return df
    w = Window.partitionBy(F.struct(*[value(k) for k in keys])).orderBy(
        *row_order(df, order_by, keys, value), *then)
    return (df.withColumn("__rn", F.row_number().over(w))
            .filter(F.col("__rn") == 1).drop("__rn"))


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """(MD5, 64-bit hash) of a row: equal exactly for rows that a grouping by ``columns`` puts together.

    Every cell is written with its length, so no two rows share a text; -0.0 counts as 0.0 and nulls
    are equal, as in a grouping; nested cells are written as JSON with their nulls."""
    cells = []
    for f in df.select(*[_c(c) for c in columns or df.columns]).schema.fields:
        c = _c(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0).cast(f.dataType)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            text = F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})
        else:
            text = c.cast("string")
        cells.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    whole = F.concat(*cells) if cells else F.lit("")
    return [F.unhex(F.md5(whole.cast("binary"))).alias("__md5"), F.xxhash64(whole).alias("__check")]


def duplicate_report(df: DataFrame, description: str = "", distinct: bool = False) -> DataFrame:
    """Total rows, unique rows, duplicate rows and rate (%, 2 dp).

    One narrow shuffle: partial counts per row fingerprint, then a global sum.
    Empty input gives zeros.  ``distinct`` states that no two rows are equal (one
    row per key): a plain count then serves both numbers, without that shuffle.
    """
    if distinct:
        agg = df.agg(F.count(F.lit(1)).cast("long").alias("total_rows")).withColumn(
            "unique_rows", F.col("total_rows"))
    else:
        grouped = df.select(*row_fingerprint(df)).groupBy("__md5", "__check").agg(F.count(F.lit(1)).alias("__n"))
        agg = grouped.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("total_rows"),
                          F.count(F.lit(1)).cast("long").alias("unique_rows"))
    return agg.select(
        F.lit(description).alias("description"),
        "total_rows", "unique_rows",
        (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        F.when(F.col("total_rows") > 0,
               round_half_even((F.col("total_rows") - F.col("unique_rows")).cast("double")
                               / F.col("total_rows").cast("double") * F.lit(100.0), 2))
        .otherwise(F.lit(0.0)).alias("duplicate_rate"),
    )


def duplicate_details(df: DataFrame, fields: Sequence[str], description: str = "", distinct: bool = False) -> DataFrame:
    """D5 with D6: the report of whole rows (field null) and one row per key field."""
    names = ["description", "field", "total", "unique", "duplicates", "duplicate_rate"]
    rows = duplicate_report(df, description, distinct).select(
        "description", F.lit(None).cast("string").alias("field"), F.col("total_rows").alias("total"),
        F.col("unique_rows").alias("unique"), F.col("duplicate_rows").alias("duplicates"), "duplicate_rate")
    return rows.unionByName(field_duplicates(df, fields).withColumn("description", F.lit(description)).select(*names))


def field_duplicates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per key field: total, unique (non-null), duplicates, rate (%, 2 dp)."""
    if not fields:
        schema = "field string, total long, unique long, duplicates long, duplicate_rate double"
        return df.sparkSession.createDataFrame([], schema)
    aggs = [F.count(F.lit(1)).alias("__total")]
    aggs += [F.count_distinct(_c(f)).alias(f"__u{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"__u{i}").alias("unique"))
        for i, f in enumerate(fields)]))
    rows = one.select(F.col("__total").alias("total"), stacked.alias("s"))
    return rows.select(
        F.col("s.field").alias("field"),
        F.col("total").cast("long").alias("total"),
        F.col("s.unique").cast("long").alias("unique"),
        (F.col("total") - F.col("s.unique")).cast("long").alias("duplicates"),
        F.when(F.col("total") > 0,
               round_half_even((F.col("total") - F.col("s.unique")).cast("double")
                               / F.col("total").cast("double") * F.lit(100.0), 2))
        .otherwise(F.lit(0.0)).alias("duplicate_rate"),
    )


def dedup_stats(before: DataFrame, after: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """before/after duplicate reports plus the key columns used (per field: ``dedup_details``).

    ``after`` is the result of the keep-first dedup by ``key_columns``: with keys it holds
    one row per key, so its rows are only counted."""
    keys = ",".join(key_columns)
    b = duplicate_report(before, "before_final_dedup").withColumn("stage", F.lit("before_final_dedup"))
    a = duplicate_report(after, "after_final_dedup", distinct=bool(key_columns)).withColumn("stage", F.lit("after_final_dedup"))
    return (b.unionByName(a)
            .withColumn("key_columns", F.lit(keys))
            .select("stage", "total_rows", "unique_rows", "duplicate_rows",
                    "duplicate_rate", "key_columns"))


def dedup_details(before: DataFrame, after: DataFrame, key_columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """D7 with D6: before/after reports of whole rows and of every key field."""
    b = duplicate_details(before, fields, "before_final_dedup")
    a = duplicate_details(after, [f for f in fields if f in after.columns], "after_final_dedup", distinct=bool(key_columns))
    return b.unionByName(a).withColumnRenamed("description", "stage").withColumn("key_columns", F.lit(",".join(key_columns)))
