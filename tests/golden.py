"""The 13-line golden micro-fixture (cleaning, matching, margin, dedup)."""

from pyspark.sql import types as T

PRODUCT_SCHEMA = T.StructType([
    T.StructField("pseq", T.IntegerType()),
    T.StructField("商家编码", T.StringType()),
    T.StructField("商品", T.StringType()),
    T.StructField("成本", T.StringType()),
])
PRODUCTS = [
    (1, " A100 ", "甲", "10.00"),
    (2, "A100", "甲2", "99"),
    (3, "商家编码", "商品", "成本"),
    (4, "B200", "乙", "abc"),
    (5, "C300", "丙", "5.5"),
    (6, None, "无", "1"),
]

ORDER_SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "seq" else T.StringType())
                             for n in ("seq", "订单号", "店铺名称", "商品编码", "买家实付", "数量",
                                       "线上订单状态", "明细状态", "订单标记", "规格")])
ORDERS = [
    (1, "O1", "店A", "A100", "100.00", "2", "已完成", None, None, "红"),
    (2, "O1", "店A", "C300", "0.00", "1", "已完成", None, "赠品", None),
    (3, "O1", "店A", "A100", "100.00", "2", "已完成", None, None, "红"),
    (4, "O2", "店B", "B200", "50", None, "已完成", None, None, None),
    (5, "O3", "店B", "C300", "0", "1", "已完成", None, None, None),
    (6, "O4", "店A", "A100", "20", "1", "关闭", None, None, None),
    (7, "O5", "店A", "A100", "20", "1", "已完成", "退款成功", None, None),
    (8, "O6", "店B", "A100", "20", "1", "[线下订单]", None, None, None),
    (9, "O7", "店A", "A100", "20", "1", "已完成", None, "空单", None),
    (10, None, "店A", "A100", "30", "1", "已完成", None, None, None),
    (11, "O8", None, "D400", "12.345", "1", "已完成", None, None, None),
    (12, "O9", "店B", " C300", "abc", "1", "已完成", None, None, None),
    (13, "O9", "店B", "C300", "33.33", "3", "已完成", None, None, None),
]


def frames(spark):
    products = spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)
    orders = spark.createDataFrame(ORDERS, ORDER_SCHEMA)
    return orders, products
