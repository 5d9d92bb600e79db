"""JSON-safe rendering of report rows.

Non-finite numbers (NaN, +/-inf) become 0 at any depth (structs, arrays and map
values); nulls stay and keep their keys.  Doubles are written as they are;
with ``scale`` they are written as decimals of that many digits, so that the text
does not depend on a float printer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import round_half_even


def _safe(c: Column, kind: T.DataType, scale: int | None) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)
        if scale is not None:
            finite = round_half_even(finite, scale).try_cast(T.DecimalType(38, scale))
        return F.when(c.isNotNull(), finite)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType, scale))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType, scale))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType, scale).alias(f.name) for f in kind.fields]))
    return c


def json_safe(df: DataFrame, scale: int | None = None) -> DataFrame:
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType, scale).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame, scale: int | None = None, name: str = "json") -> DataFrame:
    safe = json_safe(df, scale)
    row = F.struct(*[F.col(f"`{c}`") for c in safe.columns])
    return safe.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))
