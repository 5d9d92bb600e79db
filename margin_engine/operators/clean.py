"""Order-line cleaning: status / refund / offline / empty-order predicates,
the order-level amount filter and the shop filter.

Scale notes
-----------
* All row predicates are combined into one ``filter`` so Catalyst fuses them
  into the scan stage (and pushes what it can into Parquet).
* The order-level test "sum of the order's surviving amounts > 0" is a
  ``groupBy(order id)`` aggregate with map-side partial sums (a hot order
  collapses to one partial row per task) followed by a ``left_semi`` join of
  the lines against the qualifying order ids.  A window over the order id
  would put every line of a hot order into one task.  The semi join is a
  sort-merge join whose line side AQE splits when one order is hot
  (``SortMergeJoin(skew=true)``, see ``tests/test_plans.py``).
* The shop filter is applied *after* the order sum (an order can span
  several shops).  The shop list, of any length, is a frame: a left semi join, broadcast
  behind a check of its size.  Unlike an IN list it stays above the order test, so the
  line branch and the sums branch keep one plan below and share one scan and one full-width
  dedup exchange (``ReusedExchange``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import MONEY, to_number_filled
from ..functions.roles import OrderRoles
from ..functions.text import not_contains_keep_null, not_equal_keep_null
from .dedup import exact_dedup
from .joins import bounded_broadcast


@dataclass(frozen=True)
class CleanOptions:
    """Filter request: shop list (names, or a frame whose first column holds them) and the two
    include switches (P7, P9)."""

    selected_shops: tuple[str, ...] | DataFrame | None = None
    include_closed_orders: bool = False
    include_offline_orders: bool = False

    @classmethod
    def of(cls, selected_shops=None, include_closed_orders=False,
           include_offline_orders=False) -> "CleanOptions":
        if not isinstance(selected_shops, DataFrame):
            selected_shops = tuple(selected_shops) if selected_shops else None
        shops = selected_shops
        return cls(shops, bool(include_closed_orders), bool(include_offline_orders))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def all_of(preds: list[Column]) -> Column:
    """AND of all predicates, all-true when there are none."""
    return reduce(and_, preds, F.lit(True))


def keyword_predicates(roles: OrderRoles, opts: CleanOptions) -> list[Column]:
    """P2-P5 over the resolved roles (every status column, first mark column)."""
    preds: list[Column] = []
    if roles.mark:
        preds.append(not_contains_keep_null(_c(roles.mark), K.MARK_EMPTY_ORDER_FRAGMENT))
    for sc in roles.statuses:
        if not opts.include_closed_orders:
            preds.append(not_equal_keep_null(_c(sc), K.STATUS_CLOSED))
        preds.append(not_contains_keep_null(_c(sc), K.STATUS_REFUND_FRAGMENT))
        if not opts.include_offline_orders:
            preds.append(not_equal_keep_null(_c(sc), K.STATUS_OFFLINE))
    return preds


def coerce_amount(df: DataFrame, amount: str | None) -> DataFrame:
    """the amount column becomes a double with unparseable -> 0."""
    if not amount:
        return df
    dt = df.schema[amount].dataType
    return df.withColumn(amount, to_number_filled(_c(amount), 0.0, dt))


def order_sums(base: DataFrame, order_id: str, amount: str) -> DataFrame:
    """Per-order line count and exact amount sum (null order id is its own group)."""
    return base.groupBy(_c(order_id)).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(_c(amount).try_cast(MONEY)).alias("_sum"),
    ).select(_c(order_id), "n_lines",
             F.col("_sum").cast("double").alias("order_amount"),
             (F.col(order_id).isNotNull() & F.coalesce(F.col("_sum") > 0, F.lit(False)))
             .alias("kept"))


def keep_positive_orders(lines: DataFrame, base: DataFrame, order_id: str,
                         amount: str) -> DataFrame:
    """A1: keep every line of orders whose summed amount over ``base`` is > 0.

    ``lines`` is a row-filtered subset of ``base`` (or ``base`` itself).

    The sums are grouped by the one-field *struct* of the order id, so their
    output is not already partitioned on the join key: both join inputs then
    arrive through their own shuffle, which is the shape AQE's skew-join
    rule needs to split the line side of a hot order into several tasks.
    """
    qualifying = (base.groupBy(F.struct(_c(order_id)).alias("__k"))
                  .agg(F.sum(_c(amount).try_cast(MONEY)).alias("_sum"))
                  .filter((F.col("_sum") > 0) & F.col(f"__k.`{order_id}`").isNotNull())
                  .select(F.col(f"__k.`{order_id}`").alias("__oid")))
    return lines.join(qualifying, _c(order_id) == F.col("__oid"), "left_semi")


def shop_filter(df: DataFrame, shop: str | None,
                selected: Sequence[str] | DataFrame | None) -> DataFrame:
    """Lines of the listed shops; no list or no shop column means no filter.

    Null shops and null list entries match nothing.  A list that is measured too large to
    broadcast is joined by a shuffle."""
    if selected is None or not shop or (not isinstance(selected, DataFrame) and not selected):
        return df
    if not isinstance(selected, DataFrame):
        selected = df.sparkSession.createDataFrame([(str(s),) for s in selected if s is not None], "shop string")
    kind = df.schema[shop].dataType
    wanted, _ = bounded_broadcast(selected.select(
        F.col(f"`{selected.columns[0]}`").try_cast(kind).alias("__shop")).filter("__shop is not null").distinct())
    # null-safe, so that no "shop is not null" filter is inferred into one of the two branches below
    return df.join(wanted, _c(shop).eqNullSafe(F.col("__shop")), "left_semi")


@dataclass(frozen=True)
class CleanResult:
    deduped: DataFrame     # after D1 (input of the statistics)
    base: DataFrame        # after the row predicates (input of the order sum)
    cleaned: DataFrame     # final cleaned lines
    roles: OrderRoles


def clean_keyword(orders: DataFrame, opts: CleanOptions | None = None,
                  roles: OrderRoles | None = None, exact_dedup_first: bool = True,
                  order_filter: bool = True,
                  line_order_by: tuple[str, ...] | list[str] | None = None,
                  share: Callable[[DataFrame], DataFrame] | None = None) -> CleanResult:
    """Q1: keyword-schema cleaning.

    D1 exact dedup -> amount coercion -> mark/status predicates -> order-level
    amount filter (or the row-level fallback without an order id) -> shop
    filter.  ``order_filter=False`` returns the lines before the order-level
    test.  ``line_order_by`` names ordering columns (file position) that the
    exact dedup ignores when comparing rows.  ``share`` saves the lines that the order test
    reads twice: the sums do not need the ordering columns, so the two readings would not be one plan.
    """
    opts = opts or CleanOptions()
    roles = roles or OrderRoles.resolve(orders.columns)
    d1 = exact_dedup(orders, line_order_by) if exact_dedup_first else orders
    typed = coerce_amount(d1, roles.amount)
    base = typed.filter(all_of(keyword_predicates(roles, opts)))
    if roles.amount and roles.order_id:
        if order_filter and share:
            base = share(base)
        lines = base
        if order_filter:
            lines = keep_positive_orders(base, base, roles.order_id, roles.amount)
    elif roles.amount:
        # No order id column: row-level amount > 0.
        lines = base.filter(_c(roles.amount) > 0)
    else:
        lines = base
    cleaned = shop_filter(lines, roles.shop, opts.selected_shops)
    return CleanResult(deduped=d1, base=base, cleaned=cleaned, roles=roles)


def clean_fixed(orders: DataFrame, opts: CleanOptions | None = None) -> DataFrame:
    """Q5: fixed-schema cleaning (P1-P4, P6, P7); no dedup, no order test."""
    opts = opts or CleanOptions()
    need = (K.V1_PAID, K.V1_ONLINE_STATUS, K.V1_DETAIL_STATUS)
    missing = [c for c in need if c not in orders.columns]
    if missing:
        raise KeyError(f"fixed-schema cleaning needs columns {missing}")
    preds = [_c(K.V1_PAID).isNotNull()]
    if not opts.include_closed_orders:
        preds.append(not_equal_keep_null(_c(K.V1_ONLINE_STATUS), K.STATUS_CLOSED))
        preds.append(not_equal_keep_null(_c(K.V1_DETAIL_STATUS), K.STATUS_CLOSED))
    if not opts.include_offline_orders:
        preds.append(not_equal_keep_null(_c(K.V1_ONLINE_STATUS), K.STATUS_OFFLINE))
    preds.append(not_contains_keep_null(_c(K.V1_DETAIL_STATUS), K.STATUS_REFUND_FRAGMENT))
    cleaned = orders.filter(all_of(preds))
    if K.V1_SHOP in orders.columns:
        cleaned = shop_filter(cleaned, K.V1_SHOP, opts.selected_shops)
    return cleaned
