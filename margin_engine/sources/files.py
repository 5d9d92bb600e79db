"""File catalogue, role discovery, header-only reads and bounded previews.

The catalogue is a ``binaryFile`` listing without the ``content`` column, so
file bodies are never read; only names, sizes and times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import round_half_even

DEFAULT_EXTENSIONS = ("parquet", "csv", "json", "orc", "xlsx", "xls")


def file_catalogue(spark: SparkSession, directory: str,
                   extensions: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """S3 + S2: one row per data file with size, MB (2 dp), time and role."""
    listing = (spark.read.format("binaryFile")
               .option("recursiveFileLookup", "false")
               .load(directory)
               .select("path", "length", "modificationTime"))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    role = (F.when(name.contains(K.FILE_ROLE_PRODUCT), F.lit("product"))
            .when(name.contains(K.FILE_ROLE_ORDER), F.lit("order"))
            .when(name.contains(K.FILE_ROLE_BILL), F.lit("bill")))
    return (listing
            .withColumn("name", name)
            .withColumn("extension", ext)
            .filter(F.col("extension").isin(list(extensions)))
            .select("name", "path", F.col("length").alias("bytes"),
                    round_half_even(F.col("length") / F.lit(1048576.0), 2).alias("size_mb"),
                    F.col("modificationTime").alias("modified"),
                    role.alias("role")))


def pick_role_files(catalogue: DataFrame) -> DataFrame:
    """One file per role: latest modification time, then name."""
    w = Window.partitionBy("role").orderBy(F.desc("modified"), F.asc("name"))
    return (catalogue.filter(F.col("role").isNotNull())
            .withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn"))


def catalogue_total(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count("*").alias("files"),
                         F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def header_info(df: DataFrame) -> dict:
    """Columns and column count from the schema (no job)."""
    return {"columns": list(df.columns), "column_count": len(df.columns)}


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """Bounded preview of the first ``n`` rows (a limit is the feature)."""
    return df.limit(n)


def preview_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """S5 (upload analysis): first ``n`` rows with nulls shown as ''."""
    return df.limit(n).select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
                               for c in df.columns])


def preview_info(df: DataFrame, n: int = 10) -> DataFrame:
    """Shape and types of the preview of the first ``n`` rows, one row per column."""
    rows = df.limit(n).agg(F.count(F.lit(1)).cast("long").alias("preview_rows"))
    columns = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"))
               for i, f in enumerate(df.schema.fields)]
    return rows.select("preview_rows", F.lit(len(columns)).alias("preview_columns"), F.explode(F.array(*columns)).alias("c")).select(
        "c.position", "c.column", "c.dtype", "preview_rows", "preview_columns")


def table_headers(frames: dict[str, DataFrame]) -> DataFrame:
    """S4 over several tables: name, number of columns, their names, rows and files (one partial count a table)."""
    out = None
    for name, df in frames.items():
        one = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("files")).select(
            F.lit(name).alias("name"), F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"), "rows", "files")
        out = one if out is None else out.unionByName(one)
    return out
