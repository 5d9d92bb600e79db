"""Continuous ingest of order-line exports with Structured Streaming.

The source application processes each uploaded export as a whole: clean,
match against the catalogue, compute margins, dedup, report.  Here a landing
folder is watched with a file source; every micro-batch (the files that
arrived since the last one) adds its raw lines to a store, then runs the same
keyword run over all stored lines of the orders it touched, so the exact dedup,
the order-level amount test and the business dedup see whole orders however their
lines are spread over files and batches.

The store (Parquet, under the sink) is laid out by ``bucket`` (hash of the order id) and ``batch_id``:

* ``lines``: raw lines; a batch reads the buckets of the orders it touches and no others (partition pruning),
* ``touched``: the ids of the orders that a batch may have changed: those with a line that passes the row tests (any other
  line is dropped before the order's amounts are summed, so it changes no result),
* ``hits``: per order, how many of its cleaned lines each candidate key pair matches,
* ``detail`` and ``shop_rollup``: the processed lines of the touched orders and their rollup,
* ``pairs``: the key pair a batch ran with.

The key pair is the best of the whole store, as in one run over all lines: the hits of each order's last batch are summed.
When a batch changes the best pair, it runs over all stored orders once, so the result never depends on how
lines were cut into batches.  ``current_detail`` takes each order from the last batch that touched it.
A batch cleans its lines once, for the pair and the run; only lines, hits and detail of earlier batches are looked up by order.
``compact`` rewrites a bucket's many small batches as one.

All outputs are written with dynamic partition overwrite, so a batch that is re-run after a failure
replaces its own output instead of appending twice (the checkpoint records
which files each batch covered).  Without an order id column all lines are one order, which every batch runs over.
Intermediates of a batch live in a folder that is deleted when the batch is done.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.roles import OrderRoles
from ..operators import match as J
from ..operators import reports as R
from ..operators.clean import CleanOptions, clean_keyword
from ..plans.materialize import Intermediates, delete_folder, dropping_shuffles, materialize
from ..plans.workflow import run_keyword
from ..sources.csv_files import DIALECT

BUCKETS = 64
ORDER = "__order"
#: Columns of the store that are no columns of the lines.
STORE_COLUMNS = ("batch_id", "bucket")
NARROW = {"touched": f"{ORDER} string, bucket int, batch_id long",
          "hits": f"{ORDER} string, p_ix int, o_ix int, matched_lines long, bucket int, batch_id long"}
#: Files that a task keeps open at once; beyond that it sorts its rows by bucket.
OPEN_FILES = 16
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class StreamPaths:
    landing: str
    sink: str
    checkpoint: str

    def part(self, name: str) -> str:
        return f"{self.sink.rstrip('/')}/{name}"

    @property
    def detail(self) -> str:
        return self.part("detail")

    @property
    def lines(self) -> str:
        return self.part("lines")

    @property
    def touched(self) -> str:
        return self.part("touched")

    @property
    def hits(self) -> str:
        return self.part("hits")

    @property
    def pairs(self) -> str:
        return self.part("pairs")

    @property
    def shop_rollup(self) -> str:
        return self.part("shop_rollup")


def _key(column: str | None):
    return (F.col(f"`{column}`") if column else F.lit(None)).cast("string")


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Each task writes its rows where they are, one file a bucket: no row is shuffled for it, a hot order stays
    spread over the tasks that hold it, and ``compact`` joins the files.  A task keeps the files of some buckets open
    at once, so its rows are not sorted by bucket either."""
    spark = df.sparkSession
    held = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, OPEN_FILES)
    try:
        with dropping_shuffles(spark):
            (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*partitions, "batch_id").parquet(path))
    finally:
        spark.conf.set(_OPEN_FILES, held)


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    # the schemas of the narrow tables are given: a batch may have left no row in them
    schema = next((s for name, s in NARROW.items() if path.endswith(f"/{name}")), None)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).filter(F.col("batch_id") <= batch_id)


def _last_touched(spark: SparkSession, paths: StreamPaths, batch_id: int) -> DataFrame:
    return (_stored(spark, paths.touched, batch_id).groupBy("bucket", F.col(ORDER).alias("id"))
            .agg(F.max("batch_id").alias("last")).withColumnRenamed("bucket", "in_bucket"))


def _of_last_batch(df: DataFrame, last: DataFrame) -> DataFrame:
    return df.join(last, (F.col("bucket") == F.col("in_bucket")) & F.col(ORDER).eqNullSafe(F.col("id"))
                   & (F.col("batch_id") == F.col("last")), "left_semi")


def _current(spark: SparkSession, paths: StreamPaths, stored: DataFrame, newest: int) -> DataFrame:
    """The rows of ``stored`` that no later batch replaced: every order of the newest batch was touched last by it, so only
    earlier rows are looked up."""
    own, before = stored.filter(F.col("batch_id") == newest), stored.filter(F.col("batch_id") < newest)
    if before.isEmpty():
        return own
    return own.unionByName(_of_last_batch(before, _last_touched(spark, paths, newest)))


class _Store:
    """One micro-batch over the store."""

    def __init__(self, spark, paths, products, opts, product_order_by, batch_id, order, buckets):
        self.spark, self.paths, self.products, self.opts = spark, paths, products, opts
        self.product_order_by, self.batch_id, self.order, self.buckets = product_order_by, batch_id, order, buckets

    def add(self, batch: DataFrame) -> None:
        keyed = batch.withColumn("bucket", _bucket(_key(self.order), self.buckets))
        _write(keyed, self.paths.lines, self.batch_id, "bucket")
        base = clean_keyword(batch, self.opts, exact_dedup_first=False, order_filter=False).base
        ids = base.select(_key(self.order).alias(ORDER)).distinct().withColumn("bucket", _bucket(F.col(ORDER), self.buckets))
        _write(ids, self.paths.touched, self.batch_id, "bucket")

    def _touched(self, everything: bool) -> DataFrame:
        ids = _stored(self.spark, self.paths.touched, self.batch_id)
        if not everything:
            ids = ids.filter(F.col("batch_id") == self.batch_id)
        return ids.select("bucket", ORDER).distinct()

    def lines(self, everything: bool) -> DataFrame:
        """All stored lines of the touched orders, from their buckets alone; the batch's own lines need no look-up."""
        stored = _stored(self.spark, self.paths.lines, self.batch_id)
        if everything:
            return stored.drop(*STORE_COLUMNS)
        ids = self._touched(False)
        met = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        of = stored.filter(F.col("bucket").isin(met))
        own, before = of.filter(F.col("batch_id") == self.batch_id), of.filter(F.col("batch_id") < self.batch_id)
        if before.isEmpty():
            return own.drop(*STORE_COLUMNS)
        ids = ids.withColumnRenamed("bucket", "in_bucket")
        return own.unionByName(before.join(
            ids, (F.col("bucket") == F.col("in_bucket")) & _key(self.order).eqNullSafe(F.col(ORDER)), "left_semi")).drop(*STORE_COLUMNS)

    def best_pair(self, lines: DataFrame, cleaned: DataFrame):
        """The best key pair of the whole store after this batch, or ``NO_PAIR``; None without candidates."""
        cleaned = cleaned.withColumn(ORDER, _key(self.order))
        pc, oc = J.candidates(lines, self.products, self.product_order_by)
        if not pc or not oc:
            return None
        hits = J.key_hits(cleaned, self.products, pc, oc, ORDER).withColumn("bucket", _bucket(F.col(ORDER), self.buckets))
        _write(hits, self.paths.hits, self.batch_id, "bucket")
        stored = _stored(self.spark, self.paths.hits, self.batch_id)
        row = _current(self.spark, self.paths, stored, self.batch_id).drop("batch_id").groupBy("p_ix", "o_ix").agg(F.sum("matched_lines").alias("n")).orderBy(F.desc("n"), "p_ix", "o_ix").first()  # one row
        return (pc[row["p_ix"]], oc[row["o_ix"]]) if row else J.NO_PAIR

    def _pair_before(self):
        try:
            rows = _stored(self.spark, self.paths.pairs, self.batch_id - 1).orderBy(F.desc("batch_id")).limit(1).collect()
        except Exception as e:  # the first batch: nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return False, None
        return (True, rows[0]["pair"]) if rows else (False, None)

    def process(self) -> None:
        with Intermediates(self.spark, "batch"):
            lines = self.lines(False)
            with dropping_shuffles(self.spark):
                cleaned = materialize(clean_keyword(lines, self.opts).cleaned, "cleaned")  # once, for the pair and the run
            pair = self.best_pair(lines, cleaned)
            text = "|".join(pair) if isinstance(pair, tuple) else pair
            known, before = self._pair_before()
            everything = known and before != text
            if everything:  # another pair is now the best: every stored order is matched by it
                lines = self.lines(True)
                _write(self._touched(True), self.paths.touched, self.batch_id, "bucket")
                cleaned = materialize(clean_keyword(lines, self.opts).cleaned, "cleaned")
                pc, oc = J.candidates(lines, self.products, self.product_order_by)
                hits = materialize(J.key_hits(cleaned.withColumn(ORDER, _key(self.order)), self.products, pc, oc, ORDER), "hits")
                _write(hits.withColumn("bucket", _bucket(F.col(ORDER), self.buckets)), self.paths.hits, self.batch_id, "bucket")
            run = run_keyword(lines, self.products, self.opts, product_order_by=self.product_order_by, stamp="now", key_pair=pair,
                              cleaned=cleaned)
            with run:
                final = _key(run.match.order_names.get(self.order, self.order))
                detail = run.processed.withColumn(ORDER, final).withColumn("bucket", _bucket(F.col(ORDER), self.buckets))
                _write(detail, self.paths.detail, self.batch_id, "bucket")
                # the rollup reads the detail just written; its schema is given, as the batch may have left no row
                written = self.spark.read.schema(detail.withColumn("batch_id", F.lit(0).cast("long")).schema).parquet(self.paths.detail)
                _write(R.shop_rollup_keyword(written.filter(F.col("batch_id") == self.batch_id).select(
                    *[F.col(f"`{c}`") for c in run.processed.columns])), self.paths.shop_rollup, self.batch_id)
            _write(self.spark.createDataFrame([(text,)], "pair string"), self.paths.pairs, self.batch_id)


def start_ingest(spark: SparkSession, paths: StreamPaths, order_schema: T.StructType,
                 products: DataFrame, fmt: str = "parquet",
                 opts: CleanOptions | None = None,
                 product_order_by: list[str] | None = None,
                 max_files_per_trigger: int | None = None,
                 available_now: bool = False,
                 processing_time: str = "1 minute", buckets: int = BUCKETS) -> StreamingQuery:
    """Start the ingest query; ``available_now`` drains the folder and stops.

    ``buckets`` must stay the same for the life of a sink."""
    # Each arrival may be a folder of part files: look below the landing folder.
    reader = (spark.readStream.schema(order_schema).format(fmt)
              .option("recursiveFileLookup", "true"))
    if fmt == "csv":
        # the batch reader's dialect; a file whose header differs from the schema fails its batch
        reader = reader.options(**DIALECT, header=True, multiLine=True, enforceSchema=False, mode="FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(paths.landing)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        store = _Store(batch.sparkSession, paths, products, opts, product_order_by, batch_id,
                       OrderRoles.resolve(batch.columns).order_id, buckets)
        store.add(batch)
        store.process()

    writer = (stream.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", paths.checkpoint)
              .queryName(f"order-ingest-{zlib.crc32(paths.landing.encode())}"))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time))
    return writer.start()


def current_detail(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """The detail over everything that arrived: each order as the last batch left it."""
    newest = _stored(spark, paths.touched, 1 << 62).agg(F.max("batch_id")).first()[0]
    return _current(spark, paths, spark.read.parquet(paths.detail), newest).drop(ORDER, *STORE_COLUMNS, "processed_at")


def cumulative_shop_rollup(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """Shop rollup over everything that arrived so far (a batch read of the sink)."""
    return R.shop_rollup_keyword(current_detail(spark, paths))


def compact(spark: SparkSession, paths: StreamPaths, min_batches: int = 8) -> int:
    """Rewrite every bucket whose lines lie in ``min_batches`` batches or more as one; run it while no batch runs.

    The lines go to the bucket's last batch, so their contents and what later batches read stay the same.  A
    bucket's new partition replaces the last one in one step, then the earlier ones go; an interruption in between leaves
    repeated lines, which the exact dedup drops, and the next call clears.  Returns the number of buckets rewritten."""
    lines = spark.read.parquet(paths.lines)
    many = (lines.groupBy("bucket").agg(F.sort_array(F.collect_set("batch_id")).alias("ids"))
            .filter(F.size("ids") >= min_batches).collect())  # at most ``BUCKETS`` rows
    for r in many:
        with Intermediates(spark, "compact"):
            whole = materialize(lines.filter(F.col("bucket") == r["bucket"]).drop("batch_id").distinct(), "bucket")
            _write(whole, paths.lines, r["ids"][-1], "bucket")
        for old in r["ids"][:-1]:
            delete_folder(spark, f"{paths.lines}/bucket={r['bucket']}/batch_id={old}")
    return len(many)
