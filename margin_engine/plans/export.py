"""Export sinks: processed detail, shop summary and product summary, published as a whole.

1. The result is saved once as a typed Parquet table in the run's intermediates; an empty result stops here, and
   nothing appears at the target.
2. Detail and summaries are written from that table to ``<target>/_staging-<id>``.  No summary is ever computed from
   text, so line breaks, quotes and formats of a CSV export cannot change a total.
3. One rename makes the staging folder ``<target>/data``; the manifest (name, format, rows) inside it is written before.
   Readers go through ``read_export``, which knows only ``data``: they see the whole export or none.  A failed run leaves at most
   a staging folder, which the next export of that target removes.

CSV parts follow RFC 4180 (quotes doubled, cells with line breaks quoted, empty text ``""``, null empty), timestamps and dates
by the given patterns.  ``read_export`` reads every part with the schema that the manifest keeps.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import reports as R
from ..sources.csv_files import DIALECT
from .materialize import Intermediates, delete_folder, materialize

MANIFEST = "name string, format string, rows bigint, schema string, options map<string,string>"


@dataclass
class ExportResult:
    written: bool
    rows: int
    paths: dict[str, str] = field(default_factory=dict)


def timestamped(base: str, prefix: str = "processed") -> str:
    """Target folder name with a timestamp, as the export names its files."""
    return f"{base.rstrip('/')}/{prefix}_{_dt.datetime.now():%Y%m%d_%H%M%S}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _publish(spark: SparkSession, staging: str, data: str) -> None:
    fs, source = _file_system(spark, staging)
    if not fs.rename(source, _file_system(spark, data)[1]):
        raise FileExistsError(f"{data} could not be published")


def _csv_options(header: bool, date_format: str | None, timestamp_format: str | None) -> dict:
    options = {**DIALECT, "lineSep": "\n", "header": str(header).lower(), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "emptyValue": '""'}
    if date_format:
        options["dateFormat"] = date_format
    if timestamp_format:
        options["timestampFormat"] = timestamp_format
    return options


def export_run(processed: DataFrame, target: str, fmt: str = "parquet",
               summaries: bool = False, header: bool = True,
               date_format: str | None = None, timestamp_format: str | None = None) -> ExportResult:
    """Publish the detail (an empty result is refused) and, for the fixed-schema
    table, the shop and product summaries."""
    spark = processed.sparkSession
    target = target.rstrip("/")
    data, staging = f"{target}/data", f"{target}/_staging-{uuid.uuid4().hex}"
    fs, published = _file_system(spark, data)
    if fs.exists(published):
        raise FileExistsError(f"{data} is published already")
    options = _csv_options(header, date_format, timestamp_format) if fmt == "csv" else {}
    with Intermediates(spark, "export"):
        saved = materialize(processed, "detail")
        rows = saved.count()  # from the footers of the saved table
        if not rows:
            return ExportResult(False, 0, {})
        parts = {"detail": saved}
        if summaries:
            parts |= {"shop_summary": R.shop_summary(saved), "product_summary": R.product_summary(saved)}
        _, home = _file_system(spark, target)
        if fs.exists(home):
            for old in fs.globStatus(_file_system(spark, f"{target}/_staging-*")[1]) or []:
                delete_folder(spark, old.getPath().toString())
        manifest = []
        for name, df in parts.items():
            df.write.format(fmt).options(**options).save(f"{staging}/{name}")
            n = rows if name == "detail" else _read(spark, f"{staging}/{name}", fmt, df.schema, options).count()
            manifest.append((name, fmt, n, df.schema.json(), options))
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.json(f"{staging}/manifest")
        _publish(spark, staging, data)
    return ExportResult(True, rows, {name: f"{data}/{name}" for name in parts})


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType, options: dict) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":  # a part is what one task wrote, so one task reads it
        reader = reader.options(**{**options, "multiLine": "true", "mode": "FAILFAST", "enforceSchema": "true",
                                    "emptyValue": "", "nullValue": "\0"})  # an empty cell is null, a quoted one is empty text
    return reader.load(path)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """The parts of a published export: name, format, rows, schema, options."""
    return spark.read.schema(MANIFEST).json(f"{target.rstrip('/')}/data/manifest")


def read_export(spark: SparkSession, target: str, name: str = "detail") -> DataFrame:
    """A part of a published export, with the types it was written from."""
    part = read_manifest(spark, target).filter(f"name = '{name}'").first()  # one row
    if part is None:
        raise ValueError(f"the export holds no {name}")
    return _read(spark, f"{target.rstrip('/')}/data/{name}", part["format"], T.StructType.fromJson(json.loads(part["schema"])), part["options"])
