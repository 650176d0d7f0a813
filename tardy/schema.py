"""Declared schemas (no inference on the hot path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# trip rows after mapping (``arrival_seq`` or other order columns are added by the caller)
TRIP = _s(("ride_id", S), ("taxi_id", S), ("start_ms", L), ("tip", D), ("total_fare", D))
# sensor readings
READING = _s(("id", S), ("event_ms", L), ("temperature", D), ("arrival_seq", L))
# columns the watermark replay adds to its input
ANNOTATED = _s(("seq", L), ("max_seen_ms", L), ("m_vis", L), ("m_after", L), ("t_min_ms", L), ("wm_ms", L))
# one replayed window result
WINDOW_RESULT = _s(("window_start_ms", L), ("taxi_id", S), ("sum_tip", D), ("delay_ms", L), ("flushed", B))
# one accuracy row
ACCURACY = _s(("n_keys", L), ("true_sum", D), ("est_sum", D), ("global_error_pct", D), ("mae", D),
              ("mape_pct", D), ("r2", D))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types (strict casts)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name not in df.columns]
