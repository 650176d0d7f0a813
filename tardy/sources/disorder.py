"""Arrival disorder for in-order inputs.

The test ``events`` table is strictly in event-time order, so lateness needs
an arrival clock: ``arrival_ms = event_ms + delay(row)`` with a deterministic
per-row delay in ``[0, max_delay_ms)`` on a ``step_ms`` grid, and arrival
order ``(arrival_ms, id)``.  The default delay rule is the one the oracle
queries use: ``((id * 7919) % 7200) * 1000``, i.e. up to two hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.functions.columns import col_of

# The arrival-delay rule shared with the SQL oracle.
DISORDER_MULTIPLIER = 7919
DISORDER_STEPS = 7200
DISORDER_STEP_MS = 1000


def arrival_delay(id_col, multiplier: int = DISORDER_MULTIPLIER, steps: int = DISORDER_STEPS,
                  step_ms: int = DISORDER_STEP_MS):
    return F.pmod(col_of(id_col) * F.lit(multiplier), F.lit(steps)) * F.lit(step_ms)


def with_arrival_disorder(df: DataFrame, ts_ms: str, id_col: str, max_delay_ms: int | None = None,
                          out: str = "arrival_ms", step_ms: int = DISORDER_STEP_MS,
                          multiplier: int = DISORDER_MULTIPLIER) -> DataFrame:
    """Add ``arrival_ms``; replay order is then ``[arrival_ms, id_col]``."""
    steps = DISORDER_STEPS if max_delay_ms is None else max(1, int(max_delay_ms) // step_ms)
    return df.withColumn(out, col_of(ts_ms) + arrival_delay(id_col, multiplier, steps, step_ms))
