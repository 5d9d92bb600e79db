"""Numeric scalar functions, all JVM-side column expressions.

* ``to_number`` follows the lenient "coerce" parse of a text cell: optional
  surrounding white space, sign, digits with optional fraction, optional
  exponent.  Anything else (``'1,234.5'``, ``'¥12'``, ``'1d'``, ``'1_000'``,
  ``''``) becomes null.  A plain ``cast`` would raise under ANSI mode and
  ``try_cast`` alone accepts Java suffixes such as ``'1d'``, so the text is
  guarded by a regular expression first.
* ``round_half_even`` rounds like numpy: multiply, round half to even,
  divide.  ``F.round`` rounds half up on the decimal text and differs
  (``1.015`` gives ``1.02`` there, ``1.01`` here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal type used inside money sums so totals do not depend on task order.
# 22 integer and 6 fraction digits; sums have 38 digits.  Values are converted
# with try_cast: a non-finite value, or one of 1e22 or more, becomes null
# (skipped by the sum); ``money_misfits`` counts them.
MONEY = T.DecimalType(28, 6)

# FIXED VALUE: the accepted number shape (surrounding ASCII white space allowed).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC_TYPES)


def to_number(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Coerce a column to double; unparseable text becomes null.

    ``dtype`` is the input column's type when known (driver-side schema
    lookup); numeric inputs are cast directly.
    """
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and is_numeric_type(dtype):
        return c.cast("double")
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def to_number_filled(col: Column | str, default: float,
                     dtype: T.DataType | None = None) -> Column:
    """``to_number`` with nulls replaced by ``default``."""
    return F.coalesce(to_number(col, dtype), F.lit(float(default)))


def round_half_even(col: Column, digits: int) -> Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d."""
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def finite_or_zero(col: Column) -> Column:
    """Replace +/-inf and NaN by 0.0 and null by 0.0."""
    return F.when(col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf"))),
                  F.lit(0.0)).otherwise(col)


def money_sum(col: Column | str) -> Column:
    """Exact sum of money values (decimal inside, double out)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.try_cast(MONEY)).cast("double")


def exact_mean(col: Column | str) -> Column:
    """Mean computed as exact decimal sum / count; null when no values."""
    c = F.col(col) if isinstance(col, str) else col
    m = c.try_cast(MONEY)
    return F.sum(m).cast("double") / F.count(m).cast("double")


def money_misfits(col: Column | str) -> Column:
    """Number of values that the money type cannot hold (non-finite or 1e22 and more)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.count(F.when(c.isNotNull() & c.try_cast(MONEY).isNull(), F.lit(1)))


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
