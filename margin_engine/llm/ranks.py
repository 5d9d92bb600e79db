"""Ranks of rows within groups, without one task per group.

A window by group would sort a group that holds a third of all rows in one task.  Here the rows are
dealt by range over (group, order), so a large group fills many tasks; each partition numbers its
sorted rows, the numbered rows are written once to the shared checkpoint folder, and one small row
per (group, partition) carries the counts that turn these numbers into ranks within the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

_PART = "shiftright(row_at, 33)"


def ranked(df: DataFrame, group: str, order: list[str], tag: str = "ranked") -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``, nulls first) and ``size`` (rows of the group).

    ``group`` must not be null.  ``order`` must tell any two rows apart that are not alike; equal rows are
    dealt apart by their number in the input."""
    numbered = df.withColumn("row_in", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "row_in"]]
    written = materialize(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("row_at", F.monotonically_increasing_id()).drop("row_in"), tag)
    parts = materialize(written.groupBy(F.col(group).alias("part_group"), F.expr(_PART).alias("part")).agg(
        F.min("row_at").alias("part_first"), F.count(F.lit(1)).alias("part_rows")), f"{tag}-parts")
    earlier = Window.partitionBy("part_group").orderBy("part")
    parts = parts.select("*", (F.sum("part_rows").over(earlier) - F.col("part_rows")).alias("part_before"),
                         F.sum("part_rows").over(Window.partitionBy("part_group")).alias("size"))
    return (written.withColumn("part", F.expr(_PART))
            .join(parts.withColumnRenamed("part", "of_part"), (F.col(group) == F.col("part_group")) & (F.col("part") == F.col("of_part")))
            .withColumn("rank", F.expr("row_at - part_first + part_before"))
            .drop("part", "of_part", "part_group", "part_first", "part_rows", "part_before", "row_at"))
