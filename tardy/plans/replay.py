"""End-to-end replay plans: read -> annotate -> window -> split late ->
aggregate -> attach delay.  One lazy DataFrame plan per call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.operators.late import one_pass_result, split_late
from tardy.operators.watermark import annotate_watermark, with_bound
from tardy.sources.disorder import with_arrival_disorder
from tardy.sources.trips import EVENTS_COLUMNS, trips_from

HOUR_MS = 3_600_000
MINUTE_MS = 60_000
DAY_MS = 86_400_000
EVENT_ORDER = ["arrival_ms", "event_id"]


@dataclass
class WindowSpec:
    size_ms: int = HOUR_MS
    slide_ms: int | None = None
    allowed_lateness_ms: int = 0

    @property
    def slide(self) -> int:
        return int(self.slide_ms or self.size_ms)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trips(spark: SparkSession, sf_dir: str, truncate_values: bool = True) -> DataFrame:
    """``events`` as trips with a deterministic arrival clock.

    Columns: ride_id, taxi_id (event_type), start_ms, tip, total_fare, event_id,
    arrival_ms.  Replay order: ``EVENT_ORDER``.
    """
    ev = table(spark, sf_dir, "events")
    trips = trips_from(ev, EVENTS_COLUMNS, truncate_values=truncate_values, order_cols=("event_id",))
    return with_arrival_disorder(trips, "start_ms", "event_id")


def annotate(trips: DataFrame, bound_ms: int | None, order_by: list[str] = EVENT_ORDER,
             emit_every: int = 1, lanes: int = 1, n_blocks: int | None = None,
             ts: str = "start_ms") -> DataFrame:
    return annotate_watermark(trips, ts, order_by, bound_ms, emit_every=emit_every,
                              lanes=lanes, n_blocks=n_blocks)


def windowed_result(ann: DataFrame, bound_ms: int, spec: WindowSpec, keys: list[str],
                    aggs: list[Column], ts: str = "start_ms", value_cols: list[str] = ("tip",)) -> DataFrame:
    """Per (window, keys) aggregate of open pairs with firing delay (one pass)."""
    return one_pass_result(ann, ts, keys, aggs, spec.size_ms, spec.slide_ms, bound_ms=bound_ms,
                           allowed_lateness_ms=spec.allowed_lateness_ms, value_cols=list(value_cols))


def tips_result(trips: DataFrame, bound_ms: int, spec: WindowSpec, order_by: list[str] = EVENT_ORDER,
                emit_every: int = 1, lanes: int = 1, n_blocks: int | None = None) -> DataFrame:
    """Window start, taxi, tip sum and delay: the replayed tips job."""
    ann = annotate(trips, bound_ms, order_by, emit_every, lanes, n_blocks)
    res = windowed_result(ann, bound_ms, spec, ["taxi_id"], [F.sum("tip").alias("sum_tip")])
    return res.select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed")


def late_rows(trips: DataFrame, bound_ms: int, spec: WindowSpec, order_by: list[str] = EVENT_ORDER,
              emit_every: int = 1, lanes: int = 1, n_blocks: int | None = None) -> DataFrame:
    ann = annotate(trips, bound_ms, order_by, emit_every, lanes, n_blocks)
    _, late = split_late(ann, "start_ms", spec.size_ms, spec.slide_ms,
                         allowed_lateness_ms=spec.allowed_lateness_ms)
    return late


__all__ = ["WindowSpec", "event_trips", "annotate", "windowed_result", "tips_result", "late_rows",
           "with_bound", "HOUR_MS", "MINUTE_MS", "DAY_MS", "EVENT_ORDER", "table"]
