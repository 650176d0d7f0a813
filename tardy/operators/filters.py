"""Row filters and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive ``start <= col <= end``.

    On a timestamp column the bounds are cast to the column's own type, so
    the predicate reaches the Parquet scan (``PushedFilters``); on an epoch-ms
    column text bounds are read as UTC.
    """
    kind = dict(df.dtypes)[col]
    if kind.startswith("timestamp"):
        lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    elif isinstance(start, str):
        lo = F.unix_millis(F.lit(start).cast("timestamp"))
        hi = F.unix_millis(F.lit(end).cast("timestamp"))
    else:
        lo, hi = F.lit(start), F.lit(end)
    return df.where(F.col(col).between(lo, hi))


def head(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (top-k: no full sort)."""
    return df.orderBy(*order_by).limit(n)
