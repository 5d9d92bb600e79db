"""Scalar functions and role resolution."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from margin_engine.functions.jsonsafe import to_json_rows
from margin_engine.functions.numeric import round_half_even, to_number
from margin_engine.functions.roles import OrderRoles, find_columns, profile_role
from margin_engine.functions.text import (contains_ignore_case, money_display,
                                          not_contains_keep_null, not_equal_keep_null,
                                          percent_display, strip_key)

TEXTS = ["1d", "1,234.5", "¥12", "1_000", " 12 ", "12.", ".5", "+3", "-2e3", "", "abc",
         "1e", "0x10", "1.5e+2", "12 34", "0.00", "n/a", "-7.25"]


def test_coercion_matches_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", to_number(F.col("t")).alias("v")).collect()}
    want = pd.to_numeric(pd.Series(TEXTS, dtype=object), errors="coerce")
    for t, w in zip(TEXTS, want):
        g = got[t]
        if np.isnan(w):
            assert g is None, t
        else:
            assert g == w, t


def test_coercion_of_numeric_column(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    from margin_engine.functions.numeric import to_number_filled
    vals = [r[0] for r in df.select(to_number_filled("x", 1.0, df.schema["x"].dataType)).collect()]
    assert sorted(vals) == [1.0, 1.0]


def test_round_half_even_matches_numpy(spark):
    xs = [1.005, 1.015, 2.675, 0.125, -0.125, 12.345, 2.5, 3.5, 1234.5678]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == list(np.round(np.array(xs), 2))


def test_strip_key_unicode_whitespace(spark):
    df = spark.createDataFrame([("　A1 ",), (" B2 ",), (None,)], "k string")
    got = [r[0] for r in df.select(strip_key("k")).collect()]
    assert got == ["A1", "B2", None]


def test_null_safe_predicates(spark):
    df = spark.createDataFrame([("关闭",), ("退款成功",), (None,), ("已完成",)], "s string")
    kept = [r[0] for r in df.filter(not_equal_keep_null("s", "关闭")
                                    & not_contains_keep_null("s", "退款")).collect()]
    assert sorted(kept, key=str) == sorted([None, "已完成"], key=str)


def test_contains_ignore_case_is_literal(spark):
    df = spark.createDataFrame([("Shop_A",), ("ShopXA",), ("50%off",)], "s string")
    assert [r[0] for r in df.filter(contains_ignore_case("s", "p_a")).collect()] == ["Shop_A"]
    assert [r[0] for r in df.filter(contains_ignore_case("s", "%OFF")).collect()] == ["50%off"]


def test_display_format(spark):
    # by the exact binary value (1.005 and 2.675 lie below the tie), exact ties away from zero
    rows = [(12.346, 0.1234), (None, None), (1.005, 0.0025), (2.675, -0.0025), (0.125, 1.0), (-0.125, 0.0), (1234567.891, 12.5)]
    df = spark.createDataFrame(rows, "m double, r double")
    got = [tuple(r) for r in df.select(money_display("m"), percent_display("r")).collect()]
    assert got == [("¥12.35", "12.3%"), ("¥0.00", "0.0%"), ("¥1.00", "0.3%"), ("¥2.67", "-0.3%"), ("¥0.13", "100.0%"),
                   ("¥-0.13", "0.0%"), ("¥1234567.89", "1250.0%")]


def test_json_safe(spark):
    df = spark.createDataFrame([("a", 1.23456, float("inf")), ("b", None, float("nan"))],
                               "k string, x double, y double")
    got = sorted(r[0] for r in to_json_rows(df, 2).collect())
    assert got == ['{"k":"a","x":1.23,"y":0.00}', '{"k":"b","x":null,"y":0.00}']
    nested = spark.sql("SELECT 0.00004D x, array(double('NaN'), 1.0D) a, named_struct('q', double('Infinity')) s, "
                       "map('m', double('-Infinity')) m, CAST(NULL AS STRING) t")
    assert to_json_rows(nested).first()[0] == '{"x":4.0E-5,"a":[0.0,1.0],"s":{"q":0.0},"m":{"m":0.0},"t":null}'


def test_role_resolution_keyword_lists():
    cols = ["订单号", "店铺名称", "商品编码", "买家实付", "数量", "线上订单状态", "明细状态",
            "订单标记", "规格", "付款时间"]
    r = OrderRoles.resolve(cols)
    assert r.order_id == "订单号" and r.amount == "买家实付" and r.mark == "订单标记"
    assert r.statuses == ("线上订单状态", "明细状态") and r.shop == "店铺名称"
    assert find_columns(["SKU", "商家编码", "x"], ("sku", "商家编码")) == ["SKU", "商家编码"]
    # overrides win
    assert OrderRoles.resolve(cols, {"amount": "付款时间"}).amount == "付款时间"


def test_profile_roles_are_exclusive():
    names = ["商品编号", "买家实付", "订单状态", "店铺", "价格状态", "备注"]
    assert [profile_role(c) for c in names] == ["sku", "amount", "status", "shop", "amount", None]


@pytest.mark.parametrize("term,expected", [("店", 2), ("zz", 0)])
def test_shop_search(spark, term, expected):
    from margin_engine.operators.reports import shop_search
    df = spark.createDataFrame([("店A",), ("店B",), ("X",)], "shop_name string")
    assert shop_search(df, term).count() == expected
