"""Golden values of the 13-line micro-fixture (keyword pipeline and parts)."""

import pytest
from pyspark.sql import functions as F

from margin_engine import constants as K
from margin_engine.operators import clean as C
from margin_engine.operators import match as J
from margin_engine.plans.workflow import run_keyword
from margin_engine.sources.readers import drop_header_rows

from .golden import frames


@pytest.fixture(scope="module")
def run(spark):
    orders, products = frames(spark)
    return run_keyword(orders, drop_header_rows(products), product_order_by=["pseq"],
                       line_order_by=["seq"], stamp=None)


def _seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


def test_cleaned_lines(run):
    assert _seqs(run.cleaned) == [1, 2, 4, 11, 12, 13]


def test_best_pair(run):
    assert run.match.pair == ("商家编码", "商品编码")
    assert run.match.matched_lines == 5


def test_final_rows(run):
    rows = {r["seq"]: r for r in run.processed.collect()}
    assert sorted(rows) == [1, 2, 4, 11, 12]
    expect = {  # seq: code, item, unit_cost, qty, revenue, total_cost, profit, margin
        1: ("A100", "甲", 10.0, 2.0, 100.0, 20.0, 80.0, 0.8),
        2: ("C300", "丙", 5.5, 1.0, 0.0, 5.5, -5.5, 0.0),
        4: ("B200", "乙", 0.0, 1.0, 50.0, 0.0, 50.0, 1.0),
        11: ("D400", None, 0.0, 1.0, 12.34, 0.0, 12.34, 1.0),
        12: ("C300", "丙", 5.5, 1.0, 0.0, 5.5, -5.5, 0.0),
    }
    for seq, e in expect.items():
        r = rows[seq]
        got = (r["商品编码"], r["商品"], r["unit_cost"], r["quantity"], r["revenue"],
               r["total_cost"], r["profit"], r["margin"])
        assert got == e, (seq, got)
    assert rows[11]["match_status"] == K.MATCH_UNMATCHED
    assert rows[1]["match_status"] == K.MATCH_MATCHED


def test_summary(run):
    s = run.summary().collect()[0].asDict()
    assert s["total_records"] == 5
    assert s["total_shops"] == 2
    assert s["total_revenue"] == pytest.approx(162.34)
    assert s["total_cost"] == pytest.approx(31.0)
    assert s["total_profit"] == pytest.approx(131.34)
    assert s["avg_margin"] == pytest.approx(0.9333333, abs=1e-6)


def test_counters(run):
    c = {r["counter"]: r["value"] for r in run.counters().collect()}
    assert c["original_lines"] == 13
    assert c["cleaned_lines"] == 6
    assert c["cleaned_orders"] == 4
    assert c["matched_lines"] == 5


def test_shop_rollup(run):
    got = {r["shop_name"]: (r["total_orders"], r["total_revenue"], r["total_cost"],
                            r["total_profit"], r["avg_margin"])
           for r in run.shop_rollup().collect()}
    assert got == {"店A": (2, 100.0, 25.5, 74.5, 0.8), "店B": (2, 50.0, 5.5, 44.5, 1.0)}


def test_dedup_stats(run):
    st = {r["stage"]: r for r in run.dedup_stats().collect()}
    assert st["before_final_dedup"]["total_rows"] == 6
    assert st["after_final_dedup"]["total_rows"] == 5
    assert st["after_final_dedup"]["key_columns"] == "订单号,商品编码,规格"


def test_no_key_candidates(spark):
    orders, products = frames(spark)
    cleaned = C.clean_keyword(orders, line_order_by=["seq"]).cleaned
    res = J.match_keyword(cleaned, products.select("pseq", "商品", "成本"))
    assert res.status == "no_candidates"
    assert {r[0] for r in res.df.select("match_status").distinct().collect()} == {
        K.MATCH_NO_CANDIDATES}
    assert res.df.count() == 6


def test_zero_hits(spark):
    orders, products = frames(spark)
    cleaned = C.clean_keyword(orders, line_order_by=["seq"]).cleaned
    other = products.withColumn("商家编码", F.concat(F.lit("X"), F.col("商家编码")))
    res = J.match_keyword(cleaned, other)
    assert res.status == "no_hits"
    assert {r[0] for r in res.df.select("match_status").distinct().collect()} == {
        K.MATCH_ALL_FAILED}


def test_row_level_fallback_without_order_id(spark):
    orders, _ = frames(spark)
    cleaned = C.clean_keyword(orders.drop("订单号"), line_order_by=["seq"]).cleaned
    # amount > 0 per row after status/mark filters; seq 3 is a copy of seq 1;
    # line 10 has no order id to lose any more, so its amount keeps it
    assert _seqs(cleaned) == [1, 4, 10, 11, 13]


def test_shop_filter_after_order_sum(spark):
    orders, _ = frames(spark)
    # O9 is only in 店B; O1 only in 店A.  Filtering 店B keeps O2 and O9 lines.
    cleaned = C.clean_keyword(orders, C.CleanOptions.of(["店B"]), line_order_by=["seq"]).cleaned
    assert _seqs(cleaned) == [4, 12, 13]


def test_order_spanning_two_shops(spark):
    orders, _ = frames(spark)
    # Put a zero-amount line of O2 in 店C: the order sum (50) still counts it.
    extra = spark.createDataFrame(
        [(20, "O2", "店C", "B200", "0", "1", "已完成", None, None, "蓝")], orders.schema)
    cleaned = C.clean_keyword(orders.unionByName(extra), C.CleanOptions.of(["店C"]),
                              line_order_by=["seq"]).cleaned
    assert _seqs(cleaned) == [20]


def test_include_flags_are_monotone(spark):
    orders, _ = frames(spark)
    base = set(_seqs(C.clean_keyword(orders, line_order_by=["seq"]).cleaned))
    closed = set(_seqs(C.clean_keyword(orders, C.CleanOptions.of(None, True, False),
                                       line_order_by=["seq"]).cleaned))
    both = set(_seqs(C.clean_keyword(orders, C.CleanOptions.of(None, True, True),
                                     line_order_by=["seq"]).cleaned))
    assert base <= closed <= both
    assert 6 in closed and 8 in both and 8 not in closed


def test_header_row_dropped_null_key_kept(spark):
    _, products = frames(spark)
    kept = drop_header_rows(products)
    assert sorted(r["pseq"] for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_name_clash_suffixes_and_product_cost(spark):
    orders, products = frames(spark)
    orders = orders.withColumn("成本", F.lit("999"))          # an order-side cost column
    products = products.withColumn("规格", F.lit("X"))        # a product-side spec column
    run = run_keyword(orders, drop_header_rows(products), product_order_by=["pseq"],
                      line_order_by=["seq"], stamp=None, materialize_cleaned=False)
    cols = run.processed.columns
    assert {"成本_order", "成本_product", "规格_order", "规格_product"} <= set(cols)
    assert run.dedup_keys == ("订单号", "商品编码", "规格_order")
    rows = {r["seq"]: r for r in run.processed.collect()}
    assert sorted(rows) == [1, 2, 4, 11, 12]
    assert rows[1]["unit_cost"] == 10.0 and rows[1]["profit"] == 80.0


def test_no_catalogue_gives_empty_result(spark):
    orders, _ = frames(spark)
    cleaned = C.clean_keyword(orders, line_order_by=["seq"]).cleaned
    res = J.match_keyword(cleaned, None)
    assert res.status == "no_catalogue" and res.df.count() == 0
