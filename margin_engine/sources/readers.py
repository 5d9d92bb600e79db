"""Table sources: full scans of the catalogue and the order-line export.

CSV is read with an all-text schema (numbers are coerced later by the
pipeline, never by a schema guess); JSON and Parquet keep their own types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .csv_files import read_csv


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None, sep: str = ",",
               multi_line: bool = True, encoding: str = "UTF-8",
               position: str | None = None) -> DataFrame:
    """Full scan of one tabular file or directory with a header row.

    CSV files are read in splits whatever their cells hold, in any encoding, and united by
    name (``sources.csv_files``); ``multi_line=False`` states that no cell holds a line break.
    ``position`` adds each row's place in its file (``with_position``)."""
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt == "csv":
        return read_csv(spark, path, schema, sep, multi_line, encoding, position)
    if position:
        return with_position(read_table(spark, path, fmt, schema), position, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "orc":
        return reader.orc(path)
    raise ValueError(f"unsupported table format: {fmt}")


def drop_header_rows(df: DataFrame, key: str = K.V1_PRODUCT_KEY) -> DataFrame:
    """Drop embedded repeated header rows (cell equals the header text).

    A null key is kept; only an exact text match of the header is removed.
    No-op when the column is absent.
    """
    if key not in df.columns:
        return df
    return df.filter(~F.col(f"`{key}`").cast("string").eqNullSafe(F.lit(key)))


def with_position(df: DataFrame, name: str, fmt: str) -> DataFrame:
    """Add a row's place in the files just read: (path, block start, row).

    Parquet knows a row's index in its file.  JSON and ORC rows are numbered by task in
    reading order; inside one file block, which one task reads, that is the file's order."""
    parquet = fmt == "parquet"
    start = F.lit(0).cast("bigint") if parquet else F.col("_metadata.file_block_start")
    row = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("path"), start.alias("start"),
                                   row.alias("row")).alias(name))


@dataclass(frozen=True)
class LoadedPair:
    """The two tables; the ``positioned`` frames also hold each row's place in its file,
    which ``plans.workflow.run_pair`` takes as the order of "first" rows."""

    products: DataFrame
    orders: DataFrame
    positioned_products: DataFrame
    positioned_orders: DataFrame


def load_pair(spark: SparkSession, product_path: str, order_path: str,
              product_format: str | None = None, order_format: str | None = None,
              product_options: dict | None = None, order_options: dict | None = None) -> LoadedPair:
    """Read a catalogue and an order-line export together; both required.

    The options go to ``read_table`` (``encoding``, ``sep``, ``multi_line``, ``schema``)."""
    if not product_path or not order_path:
        raise ValueError("both a product file and an order file are required")

    def load(path, fmt, name, options):
        return read_table(spark, path, fmt, **{**(options or {}), "position": name})

    products = drop_header_rows(load(product_path, product_format, K.PRODUCT_POSITION, product_options))
    orders = load(order_path, order_format, K.LINE_POSITION, order_options)
    return LoadedPair(products.drop(K.PRODUCT_POSITION), orders.drop(K.LINE_POSITION), products, orders)
