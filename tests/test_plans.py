"""Physical-plan checks: the shapes the scale notes promise.

Inputs are derived from the test tables; a "hot" key is made by rewriting the
key of about a third of the rows (the stated skew assumption).
"""

import contextlib
import tempfile

import pytest
from pyspark.sql import functions as F

from margin_engine.operators import clean as C
from margin_engine.operators import match as J
from margin_engine.plans.workflow import run_keyword
from margin_engine.sources import fixtures as FX
from margin_engine.sources.readers import drop_header_rows

SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_lines(spark, sf001):
    lines = FX.order_lines(spark, sf001)
    hot = (lines.withColumn("订单号", F.when(F.col("规格") == "O", F.lit("HOT"))
                            .otherwise(F.col("订单号")))
           .withColumn("商品编码", F.when(F.col("规格") == "O", F.lit("1"))
                       .otherwise(F.col("商品编码"))))
    path = tempfile.mkdtemp(prefix="me-hot-") + "/lines"
    hot.write.parquet(path)
    return spark.read.parquet(path)


def test_hot_order_is_split_in_semi_join(spark, hot_lines):
    share = hot_lines.filter(F.col("订单号") == "HOT").count() / hot_lines.count()
    assert share > 0.3
    with conf(spark, SKEW_CONF):
        plan = executed_plan(C.clean_keyword(hot_lines).cleaned)
    assert "SortMergeJoin(skew=true)" in plan, plan


def test_hot_code_is_split_when_catalogue_not_broadcast(spark, hot_lines, sf001):
    products = drop_header_rows(FX.catalog(spark, sf001))
    cleaned = C.clean_keyword(hot_lines).cleaned
    with conf(spark, SKEW_CONF):
        res = J.match_first(cleaned, products, "商品编码", "商家编码", ["seq"],
                            max_broadcast_rows=0, dedup_after=False)
        assert not res.broadcast
        plan = executed_plan(res.df)
    assert "SortMergeJoin(skew=true)" in plan and "LeftOuter" in plan, plan


def test_catalogue_broadcast_under_bound(spark, sf001):
    lines = FX.order_lines(spark, sf001)
    products = drop_header_rows(FX.catalog(spark, sf001))
    res = J.match_first(C.clean_keyword(lines).cleaned, products, "商品编码", "商家编码", ["seq"])
    assert res.broadcast
    assert "BroadcastHashJoin" in executed_plan(res.df)


def test_business_dedup_limits_before_its_shuffle(spark, sf001):
    run = run_keyword(FX.order_lines(spark, sf001), drop_header_rows(FX.catalog(spark, sf001)),
                      product_order_by=["seq"], stamp=None)
    plan = executed_plan(run.processed)
    partial = [ln for ln in plan.splitlines() if "WindowGroupLimit" in ln and "Partial" in ln]
    assert partial, plan
    # no second full-width shuffle for the post-join exact dedup
    assert "BroadcastHashJoin" in plan


def test_row_filters_reach_the_scan(spark, sf001):
    path = tempfile.mkdtemp(prefix="me-lines-") + "/lines"
    FX.order_lines(spark, sf001).write.parquet(path)
    lines = spark.read.parquet(path)
    df = C.clean_keyword(lines, C.CleanOptions.of(["Supplier#000000001"])).cleaned
    plan = executed_plan(df)
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert any("PushedFilters" in ln and "店铺名称" in ln for ln in scans), scans


def test_key_search_reads_only_key_columns(spark, sf001):
    path = tempfile.mkdtemp(prefix="me-lines-") + "/lines"
    FX.order_lines(spark, sf001).write.parquet(path)
    lines = spark.read.parquet(path)
    products = drop_header_rows(FX.catalog(spark, sf001))
    pc, oc = J.candidates(lines, products)
    plan = executed_plan(J.key_search(lines, products, pc, oc))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lines" in ln]
    assert scan and all("买家实付" not in ln for ln in scan), scan


def test_exact_dedup_keeps_first_with_partial_hash_aggregate(spark, sf001):
    from margin_engine.operators.dedup import exact_dedup
    lines = FX.order_lines(spark, sf001).withColumn("seq", F.monotonically_increasing_id())
    dd = exact_dedup(lines, keep_first_by=["seq"])
    plan = executed_plan(dd)
    assert "SortAggregate" not in plan
    assert "partial_min(seq" in plan, plan
    assert dd.count() == FX.order_lines(spark, sf001).distinct().count()
