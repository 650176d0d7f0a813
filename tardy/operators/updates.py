"""Windows as a log: the first firing, then one row for every later change.

With an allowed lateness a window stays after it fired until the watermark has
passed its end by that much.  Rows that arrive in between are not late; each
changes the window's result and is reported at once, with the running aggregate
and the delay of the watermark it arrived under.  A key that has no row before
its window fires is first reported by its first row after.

``row_pairs`` gives the (row, window) pairs and watermark steps that both the
batch log (:func:`lateness_updates`) and the live one
(:mod:`tardy.streaming.emit`) are made of.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tardy.operators.late import _quote, attach_delay, firing, step_end_sql
from tardy.session import materialize

EARLY, AFTER, STEP = 0, 1, 2
#: arrival positions in one block of a running aggregate
RUN_BLOCK = 2_000_000


@dataclass(frozen=True)
class Agg:
    """An aggregate whose parts can be merged: ``fn`` is sum, count, min or max
    of ``col`` (count without one: of rows)."""

    name: str
    fn: str
    col: str | None = None

    def __post_init__(self):
        if self.fn not in ("sum", "count", "min", "max") or (self.col is None and self.fn != "count"):
            raise ValueError("an aggregate is sum, count, min or max of a column, or count of rows")

    def _apply(self, c: Column, fn: str) -> Column:
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[fn](c)

    def of_rows(self) -> Column:
        return self._apply(F.col(self.col) if self.col else F.lit(1), self.fn)

    def of_row(self, kind) -> Column:
        """A row as a part of type ``kind``."""
        if self.fn == "count":
            return F.col(self.col).isNotNull().cast(kind) if self.col else F.lit(1).cast(kind)
        return F.col(self.col).cast(kind)

    def of_parts(self) -> Column:
        return self._apply(F.col(self.name), "sum" if self.fn == "count" else self.fn)

    def joined(self, a: str, b: str) -> Column:
        """Value of two parts; a null part adds nothing."""
        if self.fn in ("min", "max"):
            return {"min": F.least, "max": F.greatest}[self.fn](F.col(a), F.col(b))
        return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))


def row_pairs(ann: DataFrame, ts_ms: str, keys: list[str], value_cols: list[str], size_ms: int, slide_ms: int | None,
              bound_ms: int, allowed_lateness_ms: int = 0) -> DataFrame:
    """``_kind, window_start_ms, window_end_ms, keys, value_cols, seq, m_vis,
    m_after``: every (row, window) pair whose window has not fired when the row
    arrives (EARLY) or has, but stays for the allowed lateness (AFTER), and the
    last window end that each row's watermark step closes (STEP, without keys).
    Rows with a null time or key make no pair."""
    size, slide = int(size_ms), int(slide_ms or size_ms)
    k = math.ceil(size / slide)
    q, t = _quote, _quote(ts_ms)
    wm = f"({q('m_vis')} - {int(bound_ms)})"
    known = " AND ".join([f"{q(c)} IS NOT NULL" for c in [ts_ms, *keys]])
    early, after = [], []
    for j in range(k):
        ws = f"(({t} - pmod({t}, {slide})) - {j * slide})"
        holds = f"{known} AND {t} < {ws} + {size}"
        fired = f"coalesce({ws} + {size} - 1 <= {wm}, false)"
        gone = f"coalesce({ws} + {size} - 1 + {int(allowed_lateness_ms)} <= {wm}, false)"
        early.append(f"CASE WHEN {holds} AND NOT {fired} THEN {ws} END")
        after.append(f"CASE WHEN {holds} AND {fired} AND NOT {gone} THEN {ws} END")
    after = after if allowed_lateness_ms else []
    arr = f"CAST(array({', '.join([*early, *after, step_end_sql(str(int(bound_ms)), size, slide)])}) AS array<bigint>)"
    x = ann.select(*keys, *value_cols, "seq", "m_vis", "m_after", F.posexplode(F.expr(arr)).alias("_pos", "_v")).where(F.col("_v").isNotNull())
    step = f"_pos = {k + len(after)}"
    return x.selectExpr(
        f"CASE WHEN {step} THEN {STEP} WHEN _pos < {k} THEN {EARLY} ELSE {AFTER} END AS _kind",
        f"CASE WHEN NOT ({step}) THEN _v END AS window_start_ms", f"CASE WHEN {step} THEN _v ELSE _v + {size} END AS window_end_ms",
        *[f"CASE WHEN NOT ({step}) THEN {q(c)} END AS {q(c)}" for c in [*keys, *value_cols]], "seq", "m_vis", "m_after")


def running(pairs: DataFrame, by: list[str], aggs: list[Agg], count: str = "_n") -> DataFrame:
    """``pairs`` with the running value of every aggregate and the running
    number of rows, per ``by`` in the order of ``seq``.  The order is cut into
    blocks of positions, so a group that holds most rows is spread; what the
    blocks before add comes from one row per block and group."""
    x = pairs.withColumn("_rblk", F.floor(F.col("seq") / F.lit(RUN_BLOCK)))
    own = [*aggs, Agg(count, "count")]
    parts = x.groupBy("_rblk", *by).agg(*[a.of_rows().alias(a.name) for a in own])
    before = Window.partitionBy(*by).orderBy("_rblk").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_rblk", *by, *[a.of_parts().over(before).alias(f"_c{i}") for i, a in enumerate(own)])
    upto = Window.partitionBy("_rblk", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = x.select("*", *[a.of_rows().over(upto).alias(f"_r{i}") for i, a in enumerate(own)]).join(carry, ["_rblk", *by])
    return y.select(*pairs.columns, *[a.joined(f"_c{i}", f"_r{i}").alias(a.name) for i, a in enumerate(own)])


def lateness_updates(ann: DataFrame, ts_ms: str, keys: list[str], aggs: list[Agg], size_ms: int, slide_ms: int | None = None,
                     bound_ms: int = 0, allowed_lateness_ms: int = 0) -> DataFrame:
    """The log of all windows: ``window_start_ms, keys, update, aggregates,
    delay_ms, flushed``.

    ``update`` numbers the rows of a (window, key) from 0.  Row 0 is the first
    firing (delay and ``flushed`` as in ``late.one_pass_result``), every further
    one the state after a row that came within the allowed lateness, its delay
    being the largest event time seen before it less the window's end.  The last
    row holds what the window's result is in the end.
    """
    values = sorted({a.col for a in aggs if a.col})
    pairs = row_pairs(ann, ts_ms, keys, values, size_ms, slide_ms, bound_ms, allowed_lateness_ms)
    g = materialize(pairs.where(F.col("_kind") != AFTER).groupBy("_kind", "window_start_ms", "window_end_ms", *keys).agg(
        *[a.of_rows().alias(a.name) for a in aggs], F.min(F.when(F.col("_kind") == STEP, F.col("m_after"))).alias("_fire")))
    names = [a.name for a in aggs]
    fires = firing(g, "window_end_ms", "_fire", int(slide_ms or size_ms)).withColumnRenamed("_fire", "fire_max_ms")
    early = g.where(F.col("_kind") == EARLY).select("window_start_ms", "window_end_ms", *keys, *names)
    first = attach_delay(early, fires).select("window_start_ms", *keys, F.lit(0).cast("long").alias("update"), *names, "delay_ms", "flushed")
    if not allowed_lateness_ms:
        return first
    by = ["window_start_ms", *keys]
    base = early.select(*by, *[F.col(n).alias("_b_" + n) for n in names], F.lit(1).alias("_seen"))
    later = running(pairs.where(F.col("_kind") == AFTER), by, aggs).join(base, by, "left")
    return first.unionByName(later.select(
        *by, (F.col("_n") - 1 + F.coalesce("_seen", F.lit(0))).cast("long").alias("update"), *[a.joined("_b_" + a.name, a.name).alias(a.name) for a in aggs],
        (F.col("m_vis") - F.col("window_end_ms")).alias("delay_ms"), F.lit(False).alias("flushed")))
