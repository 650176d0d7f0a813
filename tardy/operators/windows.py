"""Event-time (and processing-time) window assignment.

Windows are ``[ws, ws+size)`` in epoch ms with ``ws`` a multiple of ``slide``
(aligned to the epoch, like ``F.window``).  Tumbling: ``slide = size``.  A
row belongs to ``ceil(size/slide)`` candidate windows; the ones that do not
contain it (slide not dividing size) are filtered out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tardy.functions.columns import col_of, floor_ms


def latest_start(ts_ms, slide_ms: int) -> Column:
    """Start of the last window (largest start) that contains the time."""
    return floor_ms(ts_ms, slide_ms)


def assign_windows(df: DataFrame, ts_ms: str, size_ms: int, slide_ms: int | None = None,
                   ws: str = "window_start_ms", we: str = "window_end_ms") -> DataFrame:
    """One row per (input row, window containing it); null times get no window."""
    slide = int(slide_ms or size_ms)
    size = int(size_ms)
    k = math.ceil(size / slide)
    t = col_of(ts_ms)
    base = latest_start(t, slide)
    if k == 1:
        out = df.where(t.isNotNull()).withColumn(ws, base)
    else:
        out = (df.where(t.isNotNull())
               .withColumn("_wj", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
               .withColumn(ws, base - F.col("_wj") * F.lit(slide))
               .where(t < F.col(ws) + F.lit(size))
               .drop("_wj"))
    return out.withColumn(we, F.col(ws) + F.lit(size))
