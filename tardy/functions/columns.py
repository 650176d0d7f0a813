"""Scalar column functions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "to_epoch_ms", "micros_to_ms", "ms_to_timestamp", "parse_time_text",
    "parse_money", "truncate_whole", "floor_ms", "minutes_between", "adjust_delay_col",
    "record_text", "record_hash", "modulo_key", "TRIP_TIME_FORMAT",
]

# Text layout of trip start times in headered trip CSV files.
TRIP_TIME_FORMAT = "MM/dd/yyyy hh:mm:ss a"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_epoch_ms(c) -> Column:
    """Timestamp (zoned or NTZ, read as UTC) to epoch milliseconds, floored."""
    return F.unix_millis(col_of(c).cast("timestamp"))


def micros_to_ms(c) -> Column:
    """Epoch microseconds (long) to epoch milliseconds, floored."""
    return F.floor(col_of(c) / F.lit(1000)).cast("bigint")


def ms_to_timestamp(c) -> Column:
    return F.timestamp_millis(col_of(c))


def parse_time_text(c, fmt: str = TRIP_TIME_FORMAT) -> Column:
    """Quoted or bare pattern text, blanks around it ignored, to a UTC timestamp
    (session zone must be UTC)."""
    return F.to_timestamp(F.trim(F.regexp_replace(col_of(c), '"', "")), fmt)


def parse_money(c) -> Column:
    """Strip quotes and '$', trim; empty text is 0; otherwise a strict cast."""
    cleaned = F.trim(F.regexp_replace(col_of(c), '["$]', ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")).cast("double"), F.lit(0.0))


def truncate_whole(c) -> Column:
    """Truncate toward zero to a whole number (2.99 -> 2, -2.99 -> -2)."""
    return col_of(c).cast("bigint")


def floor_ms(c, unit_ms: int) -> Column:
    """Floor an epoch-ms value to a multiple of ``unit_ms`` (floor, also below 0)."""
    x = col_of(c)
    return x - F.pmod(x, F.lit(int(unit_ms)))


def minutes_between(a_ms, b_ms) -> Column:
    return (col_of(a_ms) - col_of(b_ms)) / F.lit(60000.0)


def adjust_delay_col(c, add_ms: int) -> Column:
    """Add ``add_ms`` to non-negative delays; flush markers (< 0) stay."""
    x = col_of(c)
    return F.when(x >= 0, x + F.lit(int(add_ms))).otherwise(x)


def record_text(*cols) -> Column:
    return F.concat_ws(",", *[col_of(c).cast("string") for c in cols])


def record_hash(*cols) -> Column:
    return F.xxhash64(*[col_of(c) for c in cols])


def modulo_key(c, k: int) -> Column:
    return F.pmod(col_of(c), F.lit(int(k)))
