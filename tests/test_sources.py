"""Sources and sinks: CSV / JSON / Parquet exports give the same run; file
catalogue; export round trip."""

import tempfile

import pytest

from pyspark.sql import functions as F

from margin_engine.operators.preview import fixed_preview, priority_columns
from margin_engine.plans.export import export_run
from margin_engine.plans.workflow import run_fixed, run_keyword
from margin_engine.sources import files as S
from margin_engine.sources import fixtures as FX
from margin_engine.sources.readers import drop_header_rows, load_pair

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_and_json_exports_match_parquet(spark):
    base = tempfile.mkdtemp(prefix="me-src-")
    lines = FX.order_lines(spark, SF).withColumn("下单时间", F.col("下单时间").cast("string"))
    catalog = FX.catalog(spark, SF).withColumn("seq", F.col("seq").cast("string"))
    lines.write.option("header", True).csv(f"{base}/orders_csv")
    catalog.write.option("header", True).csv(f"{base}/products_csv")
    lines.write.json(f"{base}/orders_json")
    catalog.write.json(f"{base}/products_json")
    want = run_keyword(lines, drop_header_rows(catalog), product_order_by=["seq"],
                       stamp=None, materialize_cleaned=False).processed
    for fmt in ("csv", "json"):
        pair = load_pair(spark, f"{base}/products_{fmt}", f"{base}/orders_{fmt}", fmt, fmt)
        assert set(pair.orders.columns) == set(lines.columns)
        orders = pair.orders.select(*lines.columns)
        products = pair.products.select(*catalog.columns)
        got = run_keyword(orders, products, product_order_by=["seq"], stamp=None,
                          materialize_cleaned=False).processed
        assert _rows(got.select(*want.columns)) == _rows(want), fmt


def test_file_catalogue_and_role_pick(spark):
    cat = S.file_catalogue(spark, SF)
    names = {r["name"] for r in cat.collect()}
    assert "lineitem.parquet" in names
    total = S.catalogue_total(cat).collect()[0]
    assert total["files"] == len(names) and total["total_bytes"] > 0
    assert S.header_info(FX.table(spark, SF, "orders"))["column_count"] == 6
    assert S.preview(FX.table(spark, SF, "orders"), 5).count() == 5


def test_export_writes_detail_and_summaries(spark):
    fixed = run_fixed(FX.order_lines(spark, SF), drop_header_rows(FX.catalog(spark, SF)),
                      stamp="2026-01-01 00:00:00")
    target = tempfile.mkdtemp(prefix="me-exp-") + "/out"
    res = export_run(fixed.processed, target, summaries=True)
    assert res.written and res.rows == fixed.processed.count()
    assert set(res.paths) == {"detail", "shop_summary", "product_summary"}
    assert spark.read.parquet(res.paths["shop_summary"]).count() > 0
    empty = export_run(fixed.processed.limit(0), target + "_empty")
    assert not empty.written and empty.rows == 0 and empty.paths == {}
    assert export_run(fixed.processed, target + "_empty").written  # the refusal left nothing behind
    bare = export_run(fixed.processed, target + "_bare", fmt="csv", summaries=True, header=False)
    assert set(bare.paths) == {"detail", "shop_summary", "product_summary"}


def test_csv_quotes_and_line_breaks(spark):
    from margin_engine.sources.readers import read_table
    base = tempfile.mkdtemp(prefix="me-csv-")
    with open(f"{base}/a.csv", "w", encoding="utf-8") as f:
        f.write('订单号,备注\nO1,"say ""hi"", ok"\nO2,"two\nlines"\n')
    rows = [tuple(r) for r in read_table(spark, base, "csv").orderBy("订单号").collect()]
    assert rows == [("O1", 'say "hi", ok'), ("O2", "two\nlines")]


def test_large_and_small_amounts_stay(spark):
    from margin_engine.operators.clean import clean_keyword
    df = spark.createDataFrame([("O1", "200000000000000"), ("O2", "0.00004")], "`订单号` string, `买家实付` string")
    assert clean_keyword(df).cleaned.count() == 2


def test_previews(spark):
    fixed = run_fixed(FX.order_lines(spark, SF), drop_header_rows(FX.catalog(spark, SF)),
                      stamp=None)
    assert priority_columns(fixed.processed.columns) == [
        "店铺名称", "商品编码", "商家编码", "成本", "买家实付", "订单标记", "订单号", "商品名称"]
    prev = fixed_preview(fixed.processed).collect()
    assert len(prev) == 10
    assert all(r["买家实付"].startswith("¥") for r in prev)


def test_role_files_pick_latest_per_role(spark):
    import os
    import time
    base = tempfile.mkdtemp(prefix="me-roles-")
    src = FX.table(spark, SF, "region").toPandas()
    for name in ("产品信息表-总.parquet", "订单9.14.parquet", "订单9.15.parquet", "账单.parquet",
                 "notes.parquet"):
        src.to_parquet(os.path.join(base, name))
        time.sleep(0.05)
    later = os.path.join(base, "订单9.14.parquet")
    os.utime(later, (time.time() + 60, time.time() + 60))     # newest order export
    picked = {r["role"]: r["name"] for r in S.pick_role_files(S.file_catalogue(spark, base)).collect()}
    assert picked == {"product": "产品信息表-总.parquet", "order": "订单9.14.parquet",
                      "bill": "账单.parquet"}


def test_first_rows_follow_the_files(spark):
    from margin_engine.plans.workflow import run_pair
    base = tempfile.mkdtemp(prefix="me-pos-")
    with open(f"{base}/p.csv", "w", encoding="utf-8") as f:
        f.write("商家编码,成本,row_num\nA,9,1\nA,10,0\n")
    with open(f"{base}/o.csv", "w", encoding="utf-8") as f:
        f.write("订单号,商品编码,买家实付,数量,规格\nO1,A,30,2,红\nO1,A,20,1,红\nO1,A,30,2,红\n")
    pair = load_pair(spark, f"{base}/p.csv", f"{base}/o.csv")
    run = run_pair(pair, stamp=None)
    rows = run.processed.collect()
    assert [(r["unit_cost"], r["quantity"], r["revenue"]) for r in rows] == [(9.0, 2.0, 30.0)]
    assert not any(c.startswith("__") for c in run.processed.columns + run.margined.columns + run.cleaned.columns)
    # parquet files know their rows' order
    pair.orders.coalesce(1).write.parquet(f"{base}/o.parquet")
    pair.products.coalesce(1).write.parquet(f"{base}/p.parquet")
    again = run_pair(load_pair(spark, f"{base}/p.parquet", f"{base}/o.parquet"), stamp=None)
    assert _rows(again.processed) == _rows(run.processed)


def test_load_pair_splits_large_files(spark):
    from margin_engine.plans.workflow import run_pair
    base = tempfile.mkdtemp(prefix="me-split-")
    with open(f"{base}/p.csv", "w", encoding="utf-8") as f:
        f.write("商家编码,成本\n" + "".join(f"P{i},{i % 7 + 1}\n" for i in range(50)))
    with open(f"{base}/o.csv", "w", encoding="utf-8") as f:
        f.write("订单号,商品编码,买家实付,数量,规格\n" + "".join(f"O{i % 1500},P{i % 50},{30 + i % 9},{i % 3 + 1},红\n" for i in range(3000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        whole = load_pair(spark, f"{base}/p.csv", f"{base}/o.csv")
        assert whole.orders.rdd.getNumPartitions() == 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        split = load_pair(spark, f"{base}/p.csv", f"{base}/o.csv")
        assert split.orders.rdd.getNumPartitions() > 1
        assert _rows(split.orders) == _rows(whole.orders)
        assert _rows(run_pair(split, stamp=None).processed) == _rows(run_pair(whole, stamp=None).processed)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_ordering_columns_play_no_role(spark):
    orders = spark.createDataFrame([("O1", "A", "30", "2", 7)], "`订单号` string, `商品编码` string, `买家实付` string, `数量` string, row_num int")
    orders = orders.select("row_num", "订单号", "商品编码", "买家实付", "数量")
    products = spark.createDataFrame([("A", "9")], "`商家编码` string, `成本` string")
    run = run_keyword(orders, products, line_order_by=["row_num"], stamp=None)
    assert [r["quantity"] for r in run.processed.collect()] == [2.0]
