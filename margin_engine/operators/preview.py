"""Result pages and fixed previews (a row limit is the feature here)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import first_column
from ..functions.numeric import is_numeric_type
from ..functions.text import money_display, percent_display, plain_display
from .dedup import row_order

# FIXED VALUES: preview priority keywords (first containing column each).
PREVIEW_PRIORITY = ("店铺", "商品编码", "商家编码", "成本", "买家实付", "订单标记")
# FIXED VALUES: columns of the fixed preview, in order.
FIXED_PREVIEW_COLUMNS = ("店铺名称", "商品名称", "商品编码", "买家实付", "成本", "利润", "毛利率")
# The engine's own names of the computed columns.
COMPUTED = {"利润": "profit", "毛利率": "margin"}
MONEY_WORDS, MONEY_COLUMNS = ("金额", "成本", "利润"), ("unit_cost", "total_cost", "profit")
PERCENT_WORDS, PERCENT_COLUMNS = ("毛利率",), ("margin",)


def result_page(df: DataFrame, n: int = 100, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by the given order (all columns break ties);
    planned as a TakeOrderedAndProject (per-task top-n, then a merge)."""
    return df.orderBy(*row_order(df, order_by)).limit(n)


def page_info(df: DataFrame, n: int = 100) -> DataFrame:
    """What stands beside a page: total rows, rows on the page, the column names (one count, no sort)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("total_rows")).select(
        "total_rows", F.least(F.col("total_rows"), F.lit(n)).alias("page_rows"),
        F.to_json(F.array(*[F.lit(c) for c in df.columns])).alias("columns"))


def priority_columns(columns: Sequence[str], extra: int = 2) -> list[str]:
    """P13 column choice: per priority keyword its first containing column,
    then the first ``extra`` columns that contain no priority keyword."""
    hits = [first_column(columns, (word,)) for word in PREVIEW_PRIORITY]
    others = [c for c in columns if not any(word in c.lower() for word in PREVIEW_PRIORITY)]
    return list(dict.fromkeys([c for c in hits if c] + others[:extra]))


def _cell(name: str, numeric: bool):
    """A preview cell: numbers of money and margin columns are formatted, missing cells are empty."""
    c = F.col(f"`{name}`")
    shown = plain_display(c, numeric)
    if numeric and (name in MONEY_COLUMNS or any(w in name for w in MONEY_WORDS)):
        shown = money_display(c)
    elif numeric and (name in PERCENT_COLUMNS or any(w in name for w in PERCENT_WORDS)):
        shown = percent_display(c)
    else:
        return shown
    return F.when(c.isNull(), F.lit("")).otherwise(shown)


def priority_preview(df: DataFrame, n: int = 10, extra: int = 2,
                     order_by: Sequence[str] | None = None) -> DataFrame:
    """The priority columns of the first ``n`` rows (full-row order)."""
    chosen = priority_columns(df.columns, extra)
    page = result_page(df, n, order_by)
    return page.select([_cell(c, is_numeric_type(df.schema[c].dataType)).alias(c) for c in chosen])


def fixed_preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """Fixed named columns (those present) of the first ``n`` rows
    (full-row order) with display formatting (F16)."""
    cols = []
    for c in FIXED_PREVIEW_COLUMNS:
        name = c if c in df.columns else COMPUTED.get(c, c)
        if name not in df.columns:
            continue
        col = F.col(f"`{name}`")
        if c in ("买家实付", "成本", "利润"):
            shown = money_display(col)
        elif c == "毛利率":
            shown = percent_display(col)
        else:
            shown = plain_display(col, False)
        cols.append(shown.alias(c))
    return result_page(df, n, order_by).select(*cols)
