"""Bound sweep and trade-off table, without a copy of a row for every bound.

The running max behind the watermark does not depend on the bound, so the table
is annotated once.  A (row, window) pair is kept by every bound over a threshold
of its own, so with the bounds in rising order it only needs the index of the
first bound that keeps it.  Pairs are aggregated by (window, key, index), once;
the value under a bound is the sum over all indexes up to it, a running sum over
the few indexes of a (window, key).  Late rows are counted the same way, from
the other end.  A watermark step names the bounds under which it passes a window
end, which only rows that raise the running max can do.  What is made for every
bound is the answer itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tardy.operators.accuracy import scored_summary
from tardy.operators.late import _quote, firing
from tardy.session import materialize

# The watermark bounds (minutes) of the recorded experiment runs.
RECORDED_BOUNDS_MIN = [0, 5, 10, 15, 23, 25, 30, 60]

PAIR, LATE, STEP = 0, 1, 2


def with_bounds(ann: DataFrame, bounds_ms: list[int], col: str = "bound_ms") -> DataFrame:
    """A copy of every row for each bound, for operators that take a bound
    column (``scored_windows``, ``one_pass_result``); the sweeps need none."""
    return ann.withColumn(col, F.explode(F.array(*[F.lit(int(b)).cast("long") for b in bounds_ms])))


def first_kept_sql(limit: str, bounds: list[int]) -> str:
    """SQL text: how many of the rising ``bounds`` are not over ``limit``, by halving."""
    def half(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {limit} < {bounds[mid]} THEN {half(lo, mid)} ELSE {half(mid + 1, hi)} END"
    return f"CASE WHEN {limit} IS NULL THEN 0 ELSE {half(0, len(bounds))} END"


def indexed_windows(ann: DataFrame, ts: str, keys: list[str], bounds: list[int], size_ms: int, slide_ms: int | None,
                    sums: dict[str, Column], allowed_lateness_ms: int = 0) -> DataFrame:
    """The small table of all bounds, written once: by ``_kind``, ``_j`` (index
    into the rising ``bounds``), window and keys,

    * PAIR: the ``sums`` and number ``_n`` of the pairs that bound ``_j`` is the
      first to keep (``len(bounds)``: none does);
    * LATE: the number ``_n`` of rows that are late under all bounds before ``_j``;
    * STEP: the least running max ``_fire`` that closes ``window_end_ms`` and all
      ends before it under bound ``_j``.
    """
    size, slide, lat = int(size_ms), int(slide_ms or size_ms), int(allowed_lateness_ms)
    k = -(-size // slide)
    q, t, vis, after = _quote, _quote(ts), _quote("m_vis"), _quote("m_after")
    known = " AND ".join(f"{q(c)} IS NOT NULL" for c in [ts, *keys])
    base = f"({t} - pmod({t}, {slide}))"

    def entry(kind: int, v: str) -> str:
        return f"named_struct('k', {kind}, 'j', CAST(NULL AS INT), 'v', CAST({v} AS BIGINT))"
    pairs = [entry(PAIR, f"CASE WHEN {known} AND {t} < {base} - {j * slide} + {size} THEN {base} - {j * slide} END") for j in range(k)]
    marker = entry(LATE, f"CASE WHEN {t} < {base} + {size} THEN {base} END")
    top = f"({after} - b + 1)"
    end = f"({top} - pmod({top} - {size}, {slide}))"
    steps = (f"transform(array({', '.join(f'CAST({b} AS BIGINT)' for b in bounds)}), (b, j) -> named_struct('k', {STEP}, 'j', j, 'v', "
             f"CASE WHEN {vis} IS NULL OR {end} > {vis} - b + 1 THEN {end} END))")
    rises = f"CASE WHEN {after} > {vis} OR ({vis} IS NULL AND {after} IS NOT NULL) THEN filter({steps}, s -> s.v IS NOT NULL) ELSE array() END"
    values = [c for c in ann.columns if c not in keys and c not in ("m_vis", "m_after")]
    x = ann.select(*keys, *values, "m_vis", "m_after", F.explode(F.expr(f"concat(array({', '.join([*pairs, marker])}), {rises})")).alias("_p"))
    x = x.where("_p.v IS NOT NULL").select("*", F.col("_p.k").alias("_kind"), F.col("_p.v").alias("_v"),
                                           F.expr(f"{vis} - (_p.v + {size - 1 + lat})").alias("_limit"))
    x = x.withColumn("_j", F.expr(f"CASE WHEN _kind < {STEP} THEN {first_kept_sql('_limit', bounds)} ELSE _p.j END"))
    pair = F.col("_kind") == PAIR
    x = x.where((F.col("_kind") != LATE) | (F.col("_j") > 0))
    x = x.select("_kind", "_j", F.when(pair, F.col("_v")).alias("window_start_ms"),
                 F.when(pair, F.col("_v") + F.lit(size)).when(F.col("_kind") == STEP, F.col("_v")).alias("window_end_ms"),
                 *[F.when(pair, F.col(c)).alias(c) for c in keys], *[F.when(pair, c).alias(n) for n, c in sums.items()],
                 F.when(F.col("_kind") == STEP, F.col("m_after")).alias("_fire"))
    return materialize(x.groupBy("_kind", "_j", "window_start_ms", "window_end_ms", *keys).agg(
        *[F.sum(n).alias(n) for n in sums], F.count(F.lit(1)).alias("_n"), F.min("_fire").alias("_fire")))


def _by_bound(g: DataFrame, keys: list[str], n_bounds: int, est: str, from_first: bool, totals: list[str] = ()) -> DataFrame:
    """PAIR rows of ``g`` for every bound ``_j``: running sum ``est`` and number
    ``_open`` of kept pairs.  ``from_first``: also the bounds that keep none.
    ``totals``: sums over all indexes."""
    by = ["window_start_ms", "window_end_ms", *keys]
    group = Window.partitionBy(*by)
    order = group.orderBy("_j")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = g.where((F.col("_kind") == PAIR) & (F.lit(True) if from_first else F.col("_j") < n_bounds))
    kept = F.col("_j") < n_bounds
    run = rows.select(*by, "_j", F.sum(F.when(kept, F.col(est))).over(upto).alias("_est"), F.sum(F.when(kept, F.col("_n"))).over(upto).alias("_open"),
                      F.least(F.lead("_j").over(order), F.lit(n_bounds)).alias("_next"), F.lag("_j").over(order).alias("_prev"),
                      *[F.sum(c).over(group).alias(c) for c in totals])
    last = F.coalesce("_next", F.lit(n_bounds)) - 1
    # the bounds from this index to the next; the first index also stands for those before it
    begin = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.col("_j")) if from_first else F.col("_j")
    run = run.select(*by, "_est", "_open", *totals, F.col("_j").alias("_first"),
                     F.explode(F.when(begin <= last, F.sequence(begin, last)).otherwise(F.array().cast("array<int>"))).alias("_j"))
    on = F.col("_j") >= F.col("_first")
    return run.select("_j", *by, F.when(on, F.col("_est")).alias("_est"), F.when(on, F.col("_open")).otherwise(F.lit(0)).alias("_open"), *totals)


def _fires(g: DataFrame, rows: DataFrame, slide: int) -> DataFrame:
    """(_j, window_end_ms, _fire) of all window ends of ``rows`` that fire."""
    ends = rows.select("_j", "window_end_ms", F.lit(None).cast("long").alias("_fire")).distinct()
    return firing(ends.unionByName(g.where(F.col("_kind") == STEP).select("_j", "window_end_ms", "_fire")), "window_end_ms", "_fire", slide, ["_j"])


def _bound_of(bounds: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'CAST({b} AS BIGINT)' for b in bounds)})")[F.col("_j")]


def sweep_bounds(ann: DataFrame, bounds_ms: list[int], size_ms: int, slide_ms: int | None = None,
                 keys: list[str] = ("taxi_id",), value: str = "tip", ts: str = "start_ms") -> DataFrame:
    """Result rows for every bound: bound_ms, window_start_ms, keys, sum, delay, flushed."""
    keys, bounds = list(keys), sorted({int(b) for b in bounds_ms})
    src = ann.select(*dict.fromkeys([*keys, value, ts, "m_vis", "m_after"]))
    g = indexed_windows(src, ts, keys, bounds, size_ms, slide_ms, {"_est": F.col(value)})
    rows = _by_bound(g, keys, len(bounds), "_est", from_first=False)
    fired = rows.join(_fires(g, rows, int(slide_ms or size_ms)), ["_j", "window_end_ms"], "left")
    return fired.select(_bound_of(bounds).alias("bound_ms"), "window_start_ms", *keys, F.col("_est").alias("sum_tip"),
                        F.coalesce(F.col("_fire") - F.col("window_end_ms"), F.lit(-1)).cast("long").alias("delay_ms"), F.col("_fire").isNull().alias("flushed"))


def tradeoff_table(ann: DataFrame, bounds_ms: list[int], size_ms: int, slide_ms: int | None = None,
                   keys: list[str] = ("taxi_id",), est_col: str = "tip", truth_col: str = "tip_raw",
                   ts: str = "start_ms") -> DataFrame:
    """Per bound: accuracy against the exact answer, average delay, late rows.

    The exact sums come from ``truth_col`` of the same pairs, under any bound,
    so no second scan or join is needed.  Columns: bound_min, n_keys, true_sum,
    est_sum, global_error_pct, mae, mape_pct, r2, avg_delay_min, n_delay,
    late_rows.
    """
    from tardy.operators.accuracy import exact

    keys, bounds = list(keys), sorted({int(b) for b in bounds_ms})
    src = ann.select(*dict.fromkeys([*keys, est_col, truth_col, ts, "m_vis", "m_after"]))
    g = indexed_windows(src, ts, keys, bounds, size_ms, slide_ms, {"_est": F.col(est_col), "_truth": exact(F.col(truth_col))})
    rows = _by_bound(g, keys, len(bounds), "_est", from_first=True, totals=["_truth"])
    fired = rows.join(_fires(g, rows.where("_open > 0"), int(slide_ms or size_ms)), ["_j", "window_end_ms"], "left")
    in_result = F.col("_open") > 0
    scored = fired.select(
        "_j", "window_start_ms", F.coalesce(F.col("_truth").cast("double"), F.lit(0.0)).alias("true_tip"), F.coalesce("_est", F.lit(0.0)).alias("est_tip"),
        F.lit(True).alias("in_truth"), in_result.alias("in_result"),
        F.when(in_result, F.coalesce(F.col("_fire") - F.col("window_end_ms"), F.lit(-1))).cast("long").alias("delay_ms"),
        F.when(in_result, F.col("_fire").isNull()).alias("flushed"), F.lit(0).cast("long").alias("late_rows"))
    late = g.where(F.col("_kind") == LATE).select(F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("_j"), F.col("_n").alias("late_rows"))
    return (scored_summary(scored.unionByName(late, allowMissingColumns=True), ["_j"])
            .withColumn("bound_min", (_bound_of(bounds) / 60000).cast("long")).drop("_j"))
