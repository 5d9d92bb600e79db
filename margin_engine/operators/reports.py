"""Summaries and rollups over a processed table.

Every report is one ``groupBy().agg()`` (map-side partial aggregation, so a
hot shop only meets partial sums) or one global ``agg``.  Money totals are
exact decimal sums cast back to double; means are exact decimal sum / count,
so results do not depend on task order or partition count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import exact_mean, money_sum, round_half_even
from ..functions.roles import first_column

# Unrounded ratios (fixed-schema margins) are averaged in double and rounded
# to this many digits so the reported mean does not depend on summation order.
MEAN_DIGITS = 6


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def shop_column(df: DataFrame) -> str | None:
    return first_column(df.columns, K.KW_SHOP)


def _cond_mean_margin(margin: Column, revenue: Column) -> Column:
    return exact_mean(F.when(revenue > 0, margin))


def summary_keyword(processed: DataFrame, shop: str | None = None) -> DataFrame:
    """A3: records, shops, cost, revenue, profit, margin mean over revenue > 0."""
    shop = shop or shop_column(processed)
    agg = processed.agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.count_distinct(_c(shop)) if shop else F.lit(0).cast("long")).alias("total_shops"),
        F.coalesce(money_sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("total_revenue"),
        _cond_mean_margin(F.col("margin"), F.col("revenue")).alias("_m"),
    )
    return agg.select(
        "total_records", "total_shops", "total_cost", "total_revenue",
        round_half_even(F.col("total_revenue") - F.col("total_cost"), 2).alias("total_profit"),
        F.when(F.col("total_revenue") > 0, F.coalesce(F.col("_m"), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("avg_margin"),
    )


def shop_rollup_keyword(processed: DataFrame, shop: str | None = None) -> DataFrame:
    """A5: per shop rows, cost, revenue, profit, conditional mean margin."""
    shop = shop or shop_column(processed)
    if not shop:
        return processed.sparkSession.createDataFrame(
            [], "shop_name string, total_orders long, total_cost double, total_revenue double, "
                "total_profit double, avg_margin double")
    g = (processed.filter(_c(shop).isNotNull())
         .groupBy(_c(shop).cast("string").alias("shop_name"))
         .agg(F.count(F.lit(1)).alias("total_orders"),
              F.coalesce(money_sum("total_cost"), F.lit(0.0)).alias("total_cost"),
              F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("total_revenue"),
              _cond_mean_margin(F.col("margin"), F.col("revenue")).alias("_m")))
    return g.select(
        "shop_name", "total_orders", "total_cost", "total_revenue",
        round_half_even(F.col("total_revenue") - F.col("total_cost"), 2).alias("total_profit"),
        F.when(F.col("total_revenue") > 0, F.coalesce(F.col("_m"), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("avg_margin"),
    )


def _v1_mean(col: Column) -> Column:
    return round_half_even(F.avg(col), MEAN_DIGITS)


def summary_fixed(processed: DataFrame) -> DataFrame:
    """A2: records, shops, products, paid, cost, profit sums, mean margin."""
    return processed.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(_c(K.V1_SHOP)).alias("total_shops"),
        F.count_distinct(_c(K.V1_ORDER_KEY)).alias("total_products"),
        F.coalesce(money_sum(K.V1_PAID), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money_sum(K.V1_COST), F.lit(0.0)).alias("total_cost"),
        F.coalesce(money_sum("profit"), F.lit(0.0)).alias("total_profit"),
        _v1_mean(F.col("margin")).alias("avg_profit_margin"),
    )


def shop_rollup_fixed(processed: DataFrame) -> DataFrame:
    """A4: per shop rows, paid, cost, profit sums and mean margin (null shop omitted)."""
    return (processed.filter(_c(K.V1_SHOP).isNotNull())
            .groupBy(_c(K.V1_SHOP).alias("shop_name"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.coalesce(money_sum(K.V1_PAID), F.lit(0.0)).alias("total_revenue"),
                 F.coalesce(money_sum(K.V1_COST), F.lit(0.0)).alias("total_cost"),
                 F.coalesce(money_sum("profit"), F.lit(0.0)).alias("total_profit"),
                 _v1_mean(F.col("margin")).alias("avg_profit_margin")))


def shop_first_products(processed: DataFrame, n: int = 5, rank_by: str = "name") -> DataFrame:
    """Per shop, products grouped by name with paid sum, profit sum and
    order-id count (2 dp); the first ``n`` by name, or by revenue when
    ``rank_by="revenue"``.  The per-shop limit runs as a window group limit,
    partially before the shuffle."""
    g = (processed.filter(_c(K.V1_SHOP).isNotNull() & _c(K.V1_PRODUCT_NAME).isNotNull())
         .groupBy(_c(K.V1_SHOP).alias("shop_name"), _c(K.V1_PRODUCT_NAME).alias("product_name"))
         .agg(round_half_even(F.coalesce(money_sum(K.V1_PAID), F.lit(0.0)), 2).alias("revenue"),
              round_half_even(F.coalesce(money_sum("profit"), F.lit(0.0)), 2).alias("profit"),
              F.count(_c(K.V1_ORDER_ID)).alias("order_count")))
    order = ([F.desc("revenue"), F.asc("product_name")] if rank_by == "revenue"
             else [F.asc("product_name")])
    w = Window.partitionBy("shop_name").orderBy(*order)
    return (g.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= n))


def shop_distribution(processed: DataFrame, shop: str = K.V1_SHOP, n: int = 10) -> DataFrame:
    """The ``n`` most frequent shops (ties by name)."""
    return (processed.filter(_c(shop).isNotNull())
            .groupBy(_c(shop).alias("shop_name")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("shop_name")).limit(n))


def shop_list(orders: DataFrame, shop: str | None = None) -> DataFrame:
    """A10: sorted distinct non-null shops."""
    shop = shop or shop_column(orders)
    return (orders.select(_c(shop).alias("shop_name")).dropna().distinct()
            .orderBy("shop_name"))


def shop_search(shops: DataFrame, term: str, col: str = "shop_name") -> DataFrame:
    """Case-insensitive literal substring search over shop names."""
    from ..functions.text import contains_ignore_case
    return shops.filter(contains_ignore_case(_c(col), term))


def _summary_by(processed: DataFrame, keys: Sequence[Column]) -> DataFrame:
    return (processed.groupBy(*keys)
            .agg(round_half_even(F.coalesce(money_sum(K.V1_PAID), F.lit(0.0)), 2).alias("paid_sum"),
                 round_half_even(F.coalesce(money_sum(K.V1_COST), F.lit(0.0)), 2).alias("cost_sum"),
                 round_half_even(F.coalesce(money_sum("profit"), F.lit(0.0)), 2).alias("profit_sum"),
                 round_half_even(F.avg("margin"), 2).alias("margin_mean"),
                 F.count(_c(K.V1_ORDER_ID)).alias("order_count")))


def shop_summary(processed: DataFrame) -> DataFrame:
    """Export shop summary, sorted by shop, null shop dropped."""
    return (_summary_by(processed.filter(_c(K.V1_SHOP).isNotNull()),
                        [_c(K.V1_SHOP).alias("shop_name")]).orderBy("shop_name"))


def product_summary(processed: DataFrame) -> DataFrame:
    """Export product summary by (product name, product code)."""
    p = processed.filter(_c(K.V1_PRODUCT_NAME).isNotNull() & _c(K.V1_ORDER_KEY).isNotNull())
    return (_summary_by(p, [_c(K.V1_PRODUCT_NAME).alias("product_name"),
                            _c(K.V1_ORDER_KEY).alias("product_code")])
            .orderBy("product_name", "product_code"))


# FIXED VALUES: text forms of a time that exports hold; the first that fits counts.
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d",
                "yyyyMMdd", "yyyy年M月d日", "yyyy-M-d'T'H:m:s")


def parse_time(col: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """A text time by the first fitting format; null if none fits."""
    text = F.trim(col.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def date_range(processed: DataFrame, time_col: str, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """First and last order time of the processed lines, in order of time.

    Text is read by ``formats``, and the cells that fit none are counted (``unparsed``); they
    play no other part.  Dates and timestamps are taken as they are."""
    c = _c(time_col)
    if dict(processed.dtypes)[time_col] != "string":
        return processed.agg(F.min(c).alias("start"), F.max(c).alias("end"))
    t = parse_time(c, formats)
    return processed.agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.when(c.isNotNull() & t.isNull(), F.lit(1))).alias("unparsed"))


def counters_frame(spark, pairs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Long (counter, value) table from one-row, one-column frames (no cross join)."""
    frames = [df.select(F.lit(name).alias("counter"), F.col(df.columns[0]).cast("long").alias("value"))
              for name, df in pairs]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

