"""Stand-in inputs built from the synthetic test tables.

The test tables are a star schema, not a shop export, so two views map them
into the schema the pipeline expects: an order-line export with the
original Chinese headers and a product catalogue.  The views only *give rows
of that schema*; they do no cleaning, matching or aggregation.  A few
deterministic rules inject the hazards a real export has (white space
around codes, unparseable and zero amounts, missing quantities, closed /
offline / refunded / empty orders, repeated lines, duplicate catalogue keys,
an embedded header row and a null key).  All rows of every table are used.

The SQL text is shared verbatim with the DuckDB oracle, so both engines see
identical inputs; ``{q}`` is the identifier quote of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER_LINE_COLUMNS = (
    "订单号", "店铺名称", "商品编码", "商品名称", "买家实付", "数量",
    "线上订单状态", "明细状态", "订单标记", "规格", "下单时间",
)
CATALOG_COLUMNS = ("商家编码", "商品", "SKU", "成本", "seq")

ORDER_LINES_SQL = """
WITH src AS (
  SELECT
    CAST(l.l_orderkey AS STRING) AS {q}订单号{q},
    s.s_name AS {q}店铺名称{q},
    CASE WHEN l.l_partkey % 7 = 0 THEN ' ' || CAST(l.l_partkey AS STRING)
         ELSE CAST(l.l_partkey AS STRING) END AS {q}商品编码{q},
    p.p_name AS {q}商品名称{q},
    CASE WHEN l.l_linenumber = 7 THEN '0.00'
         WHEN l.l_partkey % 97 = 0 THEN 'n/a'
         ELSE CAST(CAST(FLOOR(amount_units / 100) AS BIGINT) AS STRING) || '.'
              || LPAD(CAST(amount_units % 100 AS STRING), 2, '0') END AS {q}买家实付{q},
    CASE WHEN l.l_partkey % 50 = 0 THEN CAST(NULL AS STRING)
         ELSE CAST(l.l_quantity AS STRING) END AS {q}数量{q},
    CASE WHEN o.o_orderstatus = 'F' THEN '关闭'
         WHEN o.o_orderpriority = '5-LOW' THEN '[线下订单]'
         ELSE '已完成' END AS {q}线上订单状态{q},
    CASE WHEN l.l_returnflag = 'R' THEN '退款成功'
         WHEN l.l_returnflag = 'N' THEN CAST(NULL AS STRING)
         ELSE '正常' END AS {q}明细状态{q},
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN '空单'
         ELSE CAST(NULL AS STRING) END AS {q}订单标记{q},
    l.l_linestatus AS {q}规格{q},
    CAST(o.o_orderdate AS DATE) AS {q}下单时间{q},
    l.l_suppkey AS repeat_key
  FROM (SELECT *,
          -- net amount in cents, half-up: price cents x (100 - discount %) / 100
          CAST(FLOOR((CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT)
                      * (100 - CAST(FLOOR(l_discount * 100 + 0.5) AS BIGINT)) + 50) / 100.0)
               AS BIGINT) AS amount_units
        FROM {lineitem}) l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
)
{repeat}
"""

_LINE_SELECT = """SELECT {q}订单号{q}, {q}店铺名称{q}, {q}商品编码{q}, {q}商品名称{q}, {q}买家实付{q},
       {q}数量{q}, {q}线上订单状态{q}, {q}明细状态{q}, {q}订单标记{q}, {q}规格{q}, {q}下单时间{q}"""

# Lines whose supplier key is a multiple of 10 appear twice.  Spark emits the
# copy with a generator in the same pass; DuckDB with a UNION ALL.  Same rows.
REPEAT_SPARK = _LINE_SELECT + """
FROM src LATERAL VIEW explode(sequence(1, CASE WHEN repeat_key % 10 = 0 THEN 2 ELSE 1 END)) r AS copy_no"""
REPEAT_DUCKDB = _LINE_SELECT + """
FROM src
UNION ALL
""" + _LINE_SELECT + """
FROM src WHERE repeat_key % 10 = 0"""

CATALOG_SQL = """
SELECT CASE WHEN p_size <= 40 THEN CAST(p_partkey AS STRING) ELSE 'X' || CAST(p_partkey AS STRING) END AS {q}商家编码{q},
       p_name AS {q}商品{q}, p_brand AS {q}SKU{q},
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS {q}成本{q}, 1 AS seq
FROM {part}
UNION ALL
SELECT CAST(p_partkey AS STRING), p_name, p_brand,
       CAST(CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2)) AS STRING), 2
FROM {part} WHERE p_size <= 5
UNION ALL
SELECT '商家编码', '商品', 'SKU', '成本', 3 FROM (SELECT MIN(p_partkey) AS k FROM {part}) h
UNION ALL
SELECT CAST(NULL AS STRING), '无', CAST(NULL AS STRING), '1', 3
FROM (SELECT MIN(p_partkey) AS k FROM {part}) z
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_sql_text(template: str) -> str:
    return template.replace("{repeat}", REPEAT_SPARK).replace("{q}", "`")


def duckdb_sql_text(template: str) -> str:
    text = template.replace("{repeat}", REPEAT_DUCKDB).replace("{q}", '"')
    return text.format(lineitem="lineitem", orders="orders", supplier="supplier", part="part")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line export view (one row per line, repeated lines included)."""
    return spark.sql(spark_sql_text(ORDER_LINES_SQL),
                     lineitem=table(spark, sf_dir, "lineitem"),
                     orders=table(spark, sf_dir, "orders"),
                     supplier=table(spark, sf_dir, "supplier"),
                     part=table(spark, sf_dir, "part"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product catalogue view (header row and null key still inside)."""
    return spark.sql(spark_sql_text(CATALOG_SQL), part=table(spark, sf_dir, "part"))
