"""Text scalar functions: key stripping, null-safe predicates, display format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware trim: Python's str.strip removes every Unicode white-space
# character, Spark's trim only the ASCII space.
_UNICODE_TRIM = r"(?U)^\s+|\s+$"


def strip_key(col: Column | str) -> Column:
    """Stringify and strip a match key; null stays null (never matches)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c.cast("string"), _UNICODE_TRIM, "")


def not_equal_keep_null(col: Column | str, value: str) -> Column:
    """True unless the cell equals ``value``; a null cell is kept."""
    c = F.col(col) if isinstance(col, str) else col
    return ~c.cast("string").eqNullSafe(F.lit(value))


def not_contains_keep_null(col: Column | str, fragment: str) -> Column:
    """True unless the cell contains ``fragment``; a null cell is kept."""
    c = F.col(col) if isinstance(col, str) else col
    return ~F.coalesce(c.cast("string").contains(F.lit(fragment)), F.lit(False))


def contains_ignore_case(col: Column | str, term: str) -> Column:
    """Case-insensitive literal substring test (``%``/``_`` are not wildcards)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(c).contains(F.lit(term.lower())), F.lit(False))


def to_fixed(c: Column, digits: int) -> Column:
    """``digits`` decimals by the double's exact binary value, exact ties away from zero.

    ``format_number`` rounds the exact value half to even; a double is an exact
    tie at d digits only if it is an odd multiple of 2^-(d+1), so those are nudged."""
    odd = F.pmod(F.abs(c) * F.lit(float(2 ** (digits + 1))), F.lit(2.0)) == F.lit(1.0)
    nudged = F.when(odd, c + F.signum(c) * F.lit(10.0 ** -(digits + 1))).otherwise(c)
    return F.regexp_replace(F.format_number(nudged, digits), ",", "")


def _number_or_zero(col: Column | str) -> Column:
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def money_display(col: Column | str) -> Column:
    """``¥`` with two decimals; a missing number shows as zero."""
    return F.concat(F.lit("¥"), to_fixed(_number_or_zero(col), 2))


def percent_display(col: Column | str) -> Column:
    """Margin fraction as a percentage with one decimal; a missing number shows as zero."""
    return F.concat(to_fixed(_number_or_zero(col) * F.lit(100.0), 1), F.lit("%"))


def plain_display(c: Column, numeric: bool) -> Column:
    """A cell as text: missing and zero are empty, a number has no trailing zeros."""
    if not numeric:
        return F.coalesce(c.cast("string"), F.lit(""))
    d = c.cast("double")
    text = F.regexp_replace(d.try_cast("decimal(28,6)").cast("string"), r"\.?0+$", "")
    return F.when(d.isNull() | F.isnan(d) | (d == 0), F.lit("")).otherwise(text)
