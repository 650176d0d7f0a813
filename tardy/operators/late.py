"""Late split, windowed aggregation over open pairs, and firing delay.

Rules (``S`` size, ``L`` slide, ``B`` bound, ``wm`` the watermark the row
saw on arrival, ``e = ws + S`` a window end):

* a (row, window) pair is *closed* when ``e - 1 + allowed_lateness <= wm``;
  a null ``wm`` keeps every pair open;
* a row is *late* when all its windows are closed.  Window ends grow with the
  start, so this is the same as "its last window is closed": no explode and
  no shuffle are needed to decide it;
* the result aggregates open pairs per (window, key);
* a window fires on the first watermark step that reaches ``e - 1``; its
  delay is ``M - e`` with ``M`` the max event time behind that watermark, or
  ``-1`` (``flushed``) when only the end of input closes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tardy.functions.columns import col_of
from tardy.operators.windows import latest_start
from tardy.session import materialize


def closed_expr(window_end: Column, wm: Column, allowed_lateness_ms: int = 0) -> Column:
    return F.coalesce(window_end - F.lit(1) + F.lit(int(allowed_lateness_ms)) <= wm, F.lit(False))


def late_flag(ts_ms: str, size_ms: int, slide_ms: int | None = None, wm: str = "wm_ms",
              allowed_lateness_ms: int = 0) -> Column:
    """True when the row has windows and every one is already closed on arrival
    (a row in a gap between hopping windows, size < slide, has none)."""
    slide = int(slide_ms or size_ms)
    t = col_of(ts_ms)
    last_end = latest_start(t, slide) + F.lit(int(size_ms))
    return t.isNotNull() & (t < last_end) & closed_expr(last_end, F.col(wm), allowed_lateness_ms)


def mark_late(ann: DataFrame, ts_ms: str, size_ms: int, slide_ms: int | None = None,
              wm: str = "wm_ms", allowed_lateness_ms: int = 0, col: str = "is_late") -> DataFrame:
    return ann.withColumn(col, late_flag(ts_ms, size_ms, slide_ms, wm, allowed_lateness_ms))


def split_late(ann: DataFrame, ts_ms: str, size_ms: int, slide_ms: int | None = None,
               wm: str = "wm_ms", allowed_lateness_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with at least one open window, late rows): the side output."""
    flag = late_flag(ts_ms, size_ms, slide_ms, wm, allowed_lateness_ms)
    return ann.where(~flag), ann.where(flag)


def late_count(late_df: DataFrame) -> DataFrame:
    """Final value of the running late counter (one row)."""
    return late_df.agg(F.count(F.lit(1)).alias("late_rows"))


def attach_delay(result: DataFrame, fires: DataFrame, on: list[str] = ("window_end_ms",)) -> DataFrame:
    """Add ``delay_ms`` (``fire_max - end`` or -1) and ``flushed``."""
    on = list(on)
    j = result.join(fires, on, "left")
    return (j.withColumn("flushed", F.col("fire_max_ms").isNull())
            .withColumn("delay_ms", F.coalesce(F.col("fire_max_ms") - F.col("window_end_ms"), F.lit(-1)).cast("long"))
            .drop("fire_max_ms"))


def n_windows_per_row(size_ms: int, slide_ms: int | None = None) -> int:
    return math.ceil(int(size_ms) / int(slide_ms or size_ms))


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def step_end_sql(bound: str, size: int, slide: int) -> str:
    """SQL text: the last aligned window end that a row's watermark step closes
    (null if the watermark does not rise past an end)."""
    hi = f"({_quote('m_after')} - {bound} + 1)"
    end = f"({hi} - pmod({hi} - {size}, {slide}))"
    rises = f"{_quote('m_after')} IS NOT NULL AND ({_quote('m_vis')} IS NULL OR {end} > {_quote('m_vis')} - {bound} + 1)"
    return f"CASE WHEN {rises} THEN {end} END"


#: window ends in one block of the firing table
FIRING_BLOCK = 100_000


def firing(table: DataFrame, end: str, fire: str, slide_ms: int, keep: list[str] = ()) -> DataFrame:
    """(keep, end, fire): when each window end fires.

    ``table`` holds window ends and, in rows with ``fire`` set, the last end
    each watermark step closes.  Steps rise with the watermark, so an end fires
    on the step with the smallest closed end that is not before it: a running
    minimum over ends and steps in descending order, computed block by block.
    Ends lie ``slide_ms`` apart, so blocks of equal width hold a bounded number
    of them: nothing is counted or sampled to cut them.  Ends that no step
    reaches are left out.
    """
    keep = list(keep)
    rows = (table.groupBy(*keep, end, F.col(fire).isNotNull().alias("_step")).agg(F.min(fire).alias("_m"))
            .withColumn("_fblk", F.floor(F.col(end) / F.lit(FIRING_BLOCK * int(slide_ms)))))
    down = Window.partitionBy(*keep, "_fblk").orderBy(F.desc(end), F.desc("_step"))
    # one row for each block: the least step of all later blocks
    later = Window.partitionBy(*keep).orderBy(F.desc("_fblk")).rowsBetween(Window.unboundedPreceding, -1)
    after = rows.where("_step").groupBy(*keep, "_fblk").agg(F.min("_m").alias("_least"))
    blocks = rows.select(*keep, "_fblk").distinct().join(after, [*keep, "_fblk"], "left")
    blocks = blocks.select(*keep, "_fblk", F.min("_least").over(later).alias("_later"))
    best = rows.withColumn("_own", F.min("_m").over(down)).where(~F.col("_step")).join(blocks, [*keep, "_fblk"])
    return best.select(*keep, end, F.coalesce("_own", "_later").alias(fire)).where(F.col(fire).isNotNull())


def one_pass_result(ann: DataFrame, ts_ms: str, keys: list[str], aggs: list[Column],
                    size_ms: int, slide_ms: int | None = None, bound_ms: int | None = None,
                    bound_col: str | None = None, wm: str | None = "wm_ms",
                    allowed_lateness_ms: int = 0, value_cols: list[str] = ()) -> DataFrame:
    """Windowed aggregate plus firing delay from a single pass over ``ann``.

    Every row emits its open window starts and, if its watermark step closes
    window ends, the last of them; one group-by yields the per (window, key)
    aggregates and the steps.  That small table is written once, and each
    window end takes its firing value from the steps (:func:`firing`), so the
    work does not depend on how far apart event times lie.  ``aggs`` may only
    reference ``value_cols`` and ``keys``.  Rows with a null time or key are
    left out; without keys there is one row for each window.
    """
    size = int(size_ms)
    slide = int(slide_ms or size_ms)
    k = math.ceil(size / slide)
    lat = int(allowed_lateness_ms)
    # The per-row expressions are SQL text: one parse each instead of hundreds
    # of Column round trips while the plan is built (same expressions).
    q = _quote
    bnd = q(bound_col) if bound_col else str(int(bound_ms))
    w = q(wm) if (wm and not bound_col and wm in ann.columns) else f"({q('m_vis')} - {bnd})"
    t = q(ts_ms)
    keys_ok = " AND ".join([f"{q(c)} IS NOT NULL" for c in keys] or ["true"])
    pair_ws = []
    for j in range(k):
        ws = f"(({t} - pmod({t}, {slide})) - {j * slide})"
        closed = f"coalesce({ws} + {size} - 1 + {lat} <= {w}, false)"
        pair_ws.append(f"CASE WHEN {t} IS NOT NULL AND {keys_ok} AND {t} < {ws} + {size} AND NOT {closed} "
                       f"THEN {ws} END")
    arr = f"CAST(array({', '.join([*pair_ws, step_end_sql(bnd, size, slide)])}) AS array<bigint>)"
    keep = [bound_col] if bound_col else []
    x = (ann.select(*keep, *keys, *value_cols, F.col("m_after"), F.posexplode(F.expr(arr)).alias("_pos", "_v"))
         .where(F.col("_v").isNotNull()))
    pair = f"_pos < {k}"
    x = x.selectExpr(
        *[q(c) for c in keep],
        f"{pair} AS _pair",
        f"CASE WHEN {pair} THEN _v ELSE _v - {size} END AS window_start_ms",
        f"CASE WHEN {pair} THEN _v + {size} ELSE _v END AS window_end_ms",
        *[f"CASE WHEN {pair} THEN {q(c)} END AS {q(c)}" for c in [*keys, *value_cols]],
        f"CASE WHEN NOT ({pair}) THEN m_after END AS _fire")
    g = materialize(x.groupBy(*keep, "_pair", "window_start_ms", "window_end_ms", *keys)
                    .agg(*aggs, F.min("_fire").alias("_fire")))
    fires = firing(g, "window_end_ms", "_fire", slide, keep).withColumnRenamed("_fire", "fire_max_ms")
    return attach_delay(g.where("_pair").drop("_pair", "_fire"), fires, on=[*keep, "window_end_ms"])
