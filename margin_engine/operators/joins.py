"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default row bound for broadcasting a dimension (the product catalogue).
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      known_rows: int | None = None,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Hint ``df`` for broadcast only when it has at most ``max_rows`` rows
    and at most ``max_bytes`` bytes of cell text.  ``known_rows`` is an upper bound
    on the row count already proven by an earlier job: a frame proven too long is
    not measured.  Rows and bytes come from one aggregate with map-side partial
    sums.  Above a bound the frame is returned unhinted and Spark plans a
    shuffle join.
    """
    if max_rows <= 0 or (known_rows is not None and known_rows > max_rows):
        return df, False
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False
