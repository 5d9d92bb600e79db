"""Cost, profit and margin per line (row-wise, fully inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numeric import finite_or_zero, is_numeric_type, round_half_even, to_number, to_number_filled
from ..functions.roles import MarginRoles

COMPUTED = ("unit_cost", "quantity", "revenue", "total_cost", "profit", "margin")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def stamp_column(stamp: str | None = "now") -> Column | None:
    """processing stamp text; ``None`` leaves the column out."""
    if stamp is None:
        return None
    if stamp == "now":
        return F.date_format(F.current_timestamp(), K.STAMP_FORMAT)
    return F.lit(stamp)


def _typed(df: DataFrame, name: str | None, default: float) -> Column:
    if not name or name not in df.columns:
        return F.lit(float(default))
    return to_number_filled(_c(name), default, df.schema[name].dataType)


def filled(f: T.StructField) -> Column:
    """+/-inf and NaN -> 0 in a floating column, nulls -> 0 in a numeric column."""
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return finite_or_zero(_c(f.name))
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.coalesce(_c(f.name), F.lit(0).cast(f.dataType))
    return _c(f.name)


def ties(df: DataFrame, roles: MarginRoles) -> list[Column]:
    """Sort expressions in which the computed columns of rows of ``df`` differ though all filled columns agree:
    a missing quantity counts 1, not 0, and what is not finite makes a profit of 0.  Text cells decide by themselves."""
    out = []
    for name, default in ((roles.quantity, 1.0), (roles.revenue, None)):
        if name in df.columns and is_numeric_type(df.schema[name].dataType):
            c = _c(name).cast("double")
            if default is not None:
                out.append(finite_or_zero(F.coalesce(c, F.lit(default))))
            out.append(F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(False)))
    return out


def margin_keyword(df: DataFrame, roles: MarginRoles, stamp: str | None = "now") -> DataFrame:
    """Q3: unit cost (0), quantity (1), revenue (2 dp, 0), total cost, profit,
    margin (4 dp, 0 unless revenue > 0); non-finite and null numbers -> 0.

    ``roles`` must already name columns of ``df``.
    """
    unit_cost = _typed(df, roles.cost, 0.0)
    quantity = _typed(df, roles.quantity, 1.0)
    revenue = round_half_even(_typed(df, roles.revenue, 0.0), 2)
    out = (df.withColumn("unit_cost", unit_cost)
           .withColumn("quantity", quantity)
           .withColumn("revenue", revenue))
    out = out.withColumn("total_cost", round_half_even(F.col("unit_cost") * F.col("quantity"), 2))
    out = out.withColumn("profit", round_half_even(F.col("revenue") - F.col("total_cost"), 2))
    out = out.withColumn("margin", F.when(F.col("revenue") > 0,
                                          round_half_even(F.col("profit") / F.col("revenue"), 4))
                         .otherwise(F.lit(0.0)))
    out = out.select(*[filled(f).alias(f.name) for f in out.schema.fields])
    st = stamp_column(stamp)
    if st is not None:
        out = out.withColumn("processed_at", st)
    return out


def margin_fixed(df: DataFrame, paid: str = K.V1_PAID, cost: str = K.V1_COST,
                 stamp: str | None = "now") -> DataFrame:
    """Q6: paid and cost coerced in place (null when unparseable), profit =
    paid - cost (no quantity, unrounded, null when either is null), margin =
    profit / paid when paid > 0 else 0."""
    out = df.withColumn(paid, to_number(_c(paid), df.schema[paid].dataType))
    if cost in df.columns:
        out = out.withColumn(cost, to_number(_c(cost), df.schema[cost].dataType))
        cost_col = _c(cost)
    else:
        cost_col = F.lit(None).cast("double")
    if K.V1_ACTUAL_PRICE in df.columns:
        out = out.withColumn(K.V1_ACTUAL_PRICE, to_number(_c(K.V1_ACTUAL_PRICE),
                                                          df.schema[K.V1_ACTUAL_PRICE].dataType))
    out = out.withColumn("profit", _c(paid) - cost_col)
    out = out.withColumn("margin", F.when(_c(paid) > 0, F.col("profit") / _c(paid))
                         .otherwise(F.lit(0.0)))
    st = stamp_column(stamp)
    if st is not None:
        out = out.withColumn("processed_at", st)
    return out
