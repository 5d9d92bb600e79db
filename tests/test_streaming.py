"""Structured Streaming ingest: two exports arrive; the sink equals the batch run."""

import tempfile

from pyspark.sql import functions as F

from margin_engine.plans.workflow import run_keyword
from margin_engine.sources import fixtures as FX
from margin_engine.sources.readers import drop_header_rows
from margin_engine.streaming.ingest import StreamPaths, cumulative_shop_rollup, start_ingest

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_exports_streamed_equal_batch_run(spark):
    base = tempfile.mkdtemp(prefix="me-stream-")
    paths = StreamPaths(f"{base}/landing", f"{base}/sink", f"{base}/ckpt")
    lines = FX.order_lines(spark, SF)
    products = drop_header_rows(FX.catalog(spark, SF))
    # Two exports, each holding whole orders.
    part = F.pmod(F.xxhash64("订单号"), F.lit(2))
    lines.filter(part == 0).coalesce(1).write.parquet(f"{paths.landing}/export_1")
    q = start_ingest(spark, paths, lines.schema, products, product_order_by=["seq"],
                     available_now=True)
    q.awaitTermination(300)
    lines.filter(part == 1).coalesce(1).write.parquet(f"{paths.landing}/export_2")
    q = start_ingest(spark, paths, lines.schema, products, product_order_by=["seq"],
                     available_now=True)
    q.awaitTermination(300)

    detail = spark.read.parquet(paths.detail)
    assert detail.select("batch_id").distinct().count() == 2
    streamed = detail.drop("batch_id", "bucket", "processed_at")
    batch = run_keyword(lines, products, product_order_by=["seq"], stamp=None).processed
    assert _rows(streamed.select(*batch.columns)) == _rows(batch)

    total = run_keyword(lines, products, product_order_by=["seq"], stamp=None).shop_rollup()
    assert _rows(cumulative_shop_rollup(spark, paths)) == _rows(total)


def test_an_order_spread_over_batches_is_judged_whole(spark):
    from margin_engine.streaming.ingest import current_detail
    base = tempfile.mkdtemp(prefix="me-stream-")
    paths = StreamPaths(f"{base}/landing", f"{base}/sink", f"{base}/ckpt")
    schema = "`订单号` string, `商品编码` string, `买家实付` string, `规格` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    for i, rows in enumerate(([("O1", "A", "10", "x"), ("O2", "A", "7", "x")], [("O1", "A", "-10", "y")],
                              [("O2", "A", "7", "x")])):
        lines = spark.createDataFrame(rows, schema)
        lines.coalesce(1).write.parquet(f"{paths.landing}/e{i}")
        q = start_ingest(spark, paths, lines.schema, products, available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(r["订单号"], r["revenue"]) for r in current_detail(spark, paths).collect()] == [("O2", 7.0)]


def _feed(spark, paths, products, schema, rows, i, fmt="parquet", **more):
    lines = spark.createDataFrame(rows, schema)
    (lines.coalesce(1).write.options(header=True, escape='"').format(fmt)).save(f"{paths.landing}/e{i}")
    q = start_ingest(spark, paths, lines.schema, products, fmt, available_now=True, **more)
    q.awaitTermination(200)
    assert q.exception() is None
    return lines


def _paths():
    base = tempfile.mkdtemp(prefix="me-stream-")
    return StreamPaths(f"{base}/landing", f"{base}/sink", f"{base}/ckpt")


def test_batches_that_prefer_other_key_pairs_equal_the_batch_run(spark):
    from margin_engine.streaming.ingest import current_detail
    schema = "`订单号` string, `商品编码` string, `商家编码` string, `买家实付` string"
    products = spark.createDataFrame([("A", "sa", "3"), ("B", "sb", "4"), ("C", "sc", "5")], "`商家编码` string, SKU string, `成本` string")
    batches = [[("O1", "A", "x", "10"), ("O2", "zz", "sb", "7")], [("O3", "q", "sc", "7"), ("O4", "q", "sa", "9"), ("O5", "q", "sb", "9")],
               [("O6", "A", "x", "1"), ("O7", "B", "x", "2"), ("O8", "C", "x", "3"), ("O9", "C", "x", "3")], [("O1", "A", "x", "-20")]]
    paths, seen, pairs = _paths(), [], []
    for i, rows in enumerate(batches):
        _feed(spark, paths, products, schema, rows, i)
        seen += rows
        run = run_keyword(spark.createDataFrame(seen, schema), products, stamp=None)
        pairs.append(run.match.pair)
        assert _rows(current_detail(spark, paths).select(*run.processed.columns)) == _rows(run.processed)
    assert len(set(pairs)) > 1  # the best pair did change on the way


def test_a_batch_reads_the_buckets_it_touches(spark, monkeypatch):
    from margin_engine.streaming import ingest
    schema = "`订单号` string, `商品编码` string, `买家实付` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    paths, plans = _paths(), []
    real = ingest._Store.lines

    def lines(self, everything):
        df = real(self, everything)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(ingest._Store, "lines", lines)
    _feed(spark, paths, products, schema, [(f"O{i}", "A", "5") for i in range(200)], 0)
    _feed(spark, paths, products, schema, [("O7", "A", "6")], 1)
    scan = next(ln for ln in plans[1].splitlines() if "FileScan" in ln and "商品编码" in ln)
    assert "(bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0] and " = " in scan  # one bucket, by partition pruning


def test_compaction_keeps_the_result(spark):
    import os

    from margin_engine.streaming.ingest import compact, current_detail
    schema = "`订单号` string, `商品编码` string, `买家实付` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    paths = _paths()
    for i in range(3):
        _feed(spark, paths, products, schema, [(f"O{k}", "A", str(i + 1)) for k in range(4)], i, buckets=2)
    before = _rows(current_detail(spark, paths))
    assert compact(spark, paths, 3) == 2 and compact(spark, paths, 3) == 0
    assert all(len([d for d in os.listdir(f"{paths.lines}/bucket={b}") if d.startswith("batch_id")]) == 1 for b in (0, 1))
    assert _rows(current_detail(spark, paths)) == before
    _feed(spark, paths, products, schema, [("O1", "A", "-50")], 3, buckets=2)
    assert {r[0] for r in before} - {"O1"} == {r[0] for r in _rows(current_detail(spark, paths))}


def test_csv_arrivals_keep_quotes_and_line_breaks(spark):
    from margin_engine.streaming.ingest import current_detail
    schema = "`订单号` string, `商品编码` string, `买家实付` string, `备注` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    paths = _paths()
    _feed(spark, paths, products, schema, [("O1", "A", "5", 'line\n"two", x'), ("O2", "A", "6", "y")], 0, "csv")
    assert sorted(r["备注"] for r in current_detail(spark, paths).collect()) == ['line\n"two", x', "y"]
    # a file with other columns fails its batch instead of being misread
    spark.createDataFrame([("y", "O3", "A", "5")], "`备注` string, `订单号` string, `商品编码` string, `买家实付` string").coalesce(1).write.option("header", True).csv(f"{paths.landing}/e9")
    q = start_ingest(spark, paths, spark.createDataFrame([], schema).schema, products, "csv", available_now=True)
    try:
        q.awaitTermination(200)
    except Exception:  # noqa: BLE001 - the query's own failure
        pass
    assert q.exception() is not None


def test_a_batch_cleans_once_and_looks_up_earlier_lines_only(spark, monkeypatch):
    from margin_engine.streaming import ingest
    schema = "`订单号` string, `商品编码` string, `买家实付` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    paths, plans, saved = _paths(), [], []
    real, save = ingest._Store.lines, ingest.materialize

    def lines(self, everything):
        df = real(self, everything)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    def materialize(df, tag="stage"):
        saved.append(tag)
        return save(df, tag)

    monkeypatch.setattr(ingest._Store, "lines", lines)
    monkeypatch.setattr(ingest, "materialize", materialize)
    _feed(spark, paths, products, schema, [("O1", "A", "5"), ("O2", "A", "6")], 0)
    _feed(spark, paths, products, schema, [("O1", "A", "-9"), (None, "A", "1")], 1)
    assert saved == ["cleaned", "cleaned"]  # the lines are cleaned once a batch and saved in no other form
    assert "Join" not in plans[0] and plans[1].count("Join") == 1 and "Union" in plans[1]
    assert [(r["订单号"], r["revenue"]) for r in ingest.current_detail(spark, paths).collect()] == [("O2", 6.0)]
    _feed(spark, paths, products, schema, [("O1", "A", "20"), ("O1", "A", "20")], 2)
    assert sorted(r["订单号"] for r in ingest.current_detail(spark, paths).collect()) == ["O1", "O2"]
