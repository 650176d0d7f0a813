"""Exact batch answer and accuracy of a replayed result.

Sums that are compared across runs or engines are taken in DECIMAL of 38
digits, so they do not depend on the order rows are added in; ratios are then
formed in DOUBLE from those exact totals.  Decimal columns keep their own scale;
of doubles six decimals are summed, finer than any money column.  R^2 compares
sums of squares around the mean, which Spark merges as moments in DOUBLE; it is
given to nine decimals, the rest being order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tardy.operators.windows import assign_windows

# six decimals of a double: exact sums at any row order and up to 10^31
DEC = "decimal(38,6)"
# fixed value: a truth over this counts as nonzero
NONZERO = 1e-9


def sum_type(kind: str) -> str:
    """Type that a column is summed in: a decimal column keeps its scale."""
    return f"decimal(38,{kind[8:-1].split(',')[1]})" if kind.startswith("decimal") else DEC


def exact(c: Column, kind: str = "double") -> Column:
    return c.cast(sum_type(kind))


def ground_truth(df: DataFrame, ts_ms: str, keys: list[str], value: str, size_ms: int,
                 slide_ms: int | None = None, out: str = "true_tip") -> DataFrame:
    """Exact per (window, keys) sum of every row (no watermark, no lateness).

    Null times and null keys are left out; a group of null values sums to 0.
    """
    ok = F.col(ts_ms).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    kind = dict(df.dtypes)[value]
    pairs = assign_windows(df.where(ok), ts_ms, size_ms, slide_ms)
    return pairs.groupBy("window_start_ms", *keys).agg(
        F.coalesce(F.sum(exact(F.col(value), kind)).cast("double"), F.lit(0.0)).alias(out))


def align_results(truth: DataFrame, result: DataFrame, keys: list[str], truth_col: str = "true_tip",
                  result_col: str = "sum_tip", extra_on: list[str] = ()) -> DataFrame:
    """Full outer join on (window, keys); an absent side reads 0.0."""
    on = [*extra_on, "window_start_ms", *keys]
    t = truth.select(*on, F.col(truth_col).alias("_t"), F.lit(True).alias("_in_truth"))
    r = result.select(*on, F.col(result_col).alias("_r"), F.lit(True).alias("_in_result"))
    j = t.join(r, on, "full_outer")
    return j.select(*on,
                    F.coalesce("_t", F.lit(0.0)).alias("true_tip"),
                    F.coalesce("_r", F.lit(0.0)).alias("est_tip"),
                    F.coalesce("_in_truth", F.lit(False)).alias("in_truth"),
                    F.coalesce("_in_result", F.lit(False)).alias("in_result"))


def metric_columns(tolerance: float = 0.01, where: Column | None = None) -> list[Column]:
    """Aggregates over an aligned table (columns true_tip, est_tip, in_truth,
    in_result), over the rows with ``where`` only if given."""
    g, e = exact(F.col("true_tip")), exact(F.col("est_tip"))
    n = F.count(F.lit(1))
    if where is not None:
        g, e, n = F.when(where, g), F.when(where, e), F.count(F.when(where, 1))
    t_sum = F.sum(g).cast("double")
    e_sum = F.sum(e).cast("double")
    nz = (F.col("true_tip") > F.lit(NONZERO)) if where is None else where & (F.col("true_tip") > F.lit(NONZERO))
    ape = F.when(nz, exact(F.abs((F.col("est_tip") - F.col("true_tip")) / F.col("true_tip")) * 100))
    diff = (e - g).cast("double")
    ss_res = F.sum(diff * diff)
    ss_tot = F.var_pop(g.cast("double")) * n
    correct = F.col("in_truth") & F.col("in_result") & (F.abs(e - g).cast("double") <= F.lit(float(tolerance)))
    return [
        n.alias("n_keys"),
        t_sum.alias("true_sum"),
        e_sum.alias("est_sum"),
        F.when(t_sum != 0, F.abs(t_sum - e_sum) / t_sum * 100).alias("global_error_pct"),
        (F.sum(F.abs((e - g).cast(DEC))).cast("double") / n).alias("mae"),
        (F.sum(ape).cast("double") / F.count(ape)).alias("mape_pct"),
        F.when(ss_tot > 0, F.round(F.lit(1.0) - ss_res / ss_tot, 9)).otherwise(F.lit(0.0)).alias("r2"),
        F.count(F.when(F.col("in_truth"), 1)).alias("n_truth"),
        F.count(F.when(F.col("in_result"), 1)).alias("n_result"),
        F.count(F.when(correct, 1)).alias("correct"),
        F.count(F.when(F.col("in_truth") & ~F.col("in_result"), 1)).alias("missing"),
        F.count(F.when(~F.col("in_truth") & F.col("in_result"), 1)).alias("extra"),
    ]


def accuracy_metrics(aligned: DataFrame, group: list[str] = ()) -> DataFrame:
    """Global error %, MAE, MAPE % (keys with truth > 1e-9), R^2 (0 if SStot = 0)."""
    cols = metric_columns()[:7]
    return aligned.groupBy(*group).agg(*cols)


def accuracy_verdicts(aligned: DataFrame, tolerance: float = 0.01, group: list[str] = ()) -> DataFrame:
    """Key verdicts: total, correct, incorrect (includes missing), missing, extra, accuracy %."""
    m = aligned.groupBy(*group).agg(*metric_columns(tolerance))
    return m.select(*group, F.col("n_keys").alias("total_keys"), "n_truth", "n_result", "correct",
                    (F.col("n_keys") - F.col("correct")).alias("incorrect"), "missing", "extra",
                    (F.col("correct") / F.col("n_keys") * 100).alias("accuracy_pct"))


def delay_columns(include_flushed: bool = False, suffix: str = "") -> list[Column]:
    """Average firing delay in minutes over result lines (0 when none) and the
    number of lines in it.

    Default leaves flushed windows out (sliding rule); ``include_flushed``
    counts their -1 as the tumbling comparison script did.
    """
    d = F.col("delay_ms") if include_flushed else F.when(~F.col("flushed"), F.col("delay_ms"))
    return [F.coalesce(F.sum(d).cast("double") / F.count(d) / F.lit(60000.0), F.lit(0.0)).alias("avg_delay_min" + suffix),
            F.count(d).alias("n_delay" if not suffix else "n" + suffix)]


def scored_windows(ann: DataFrame, ts_ms: str, keys: list[str], size_ms: int, slide_ms: int | None = None,
                   bound_ms: int | None = None, bound_col: str | None = None, est_col: str = "tip",
                   truth_col: str = "tip_raw", allowed_lateness_ms: int = 0, late_counts: bool = False) -> DataFrame:
    """Exact answer, replayed estimate and firing delay from one pass.

    Every (row, window) pair adds its ``truth_col`` to the exact sum; pairs
    still open on arrival add ``est_col`` to the estimate.  Rows:
    ``[bound,] window_start_ms, keys, true_tip, est_tip, in_truth, in_result,
    delay_ms, flushed`` -- the aligned table, without a join.  With
    ``late_counts`` one extra row per bound has null window/keys and
    ``late_rows`` set.  Firing as in ``late.one_pass_result``.
    """
    from tardy.operators.late import _quote, firing, step_end_sql
    from tardy.session import materialize

    size = int(size_ms)
    slide = int(slide_ms or size_ms)
    k = -(-size // slide)
    # per-row expressions as SQL text (see late.one_pass_result)
    q = _quote
    lat = int(allowed_lateness_ms)
    truth_type = sum_type(dict(ann.dtypes)[truth_col])
    keep = [bound_col] if bound_col else []
    bnd = q(bound_col) if bound_col else str(int(bound_ms))
    w = f"({q('m_vis')} - {bnd})"
    t = q(ts_ms)
    keys_ok = " AND ".join([f"{q(c)} IS NOT NULL" for c in keys] or ["true"])
    base = f"({t} - pmod({t}, {slide}))"
    wins = [f"CASE WHEN {t} IS NOT NULL AND {keys_ok} AND {t} < {base} - {j * slide} + {size} "
            f"THEN {base} - {j * slide} END" for j in range(k)]
    late_row = (f"{t} IS NOT NULL AND {t} < {base} + {size} "
                f"AND coalesce({base} + {size} - 1 + {lat} <= {w}, false)")
    marker = f"CASE WHEN {late_row} THEN CAST(0 AS BIGINT) END" if late_counts else "CAST(NULL AS BIGINT)"
    arr = f"CAST(array({', '.join([*wins, marker, step_end_sql(bnd, size, slide)])}) AS array<bigint>)"
    x = (ann.select(*keep, *keys, est_col, truth_col, "m_vis", "m_after",
                    F.posexplode(F.expr(arr)).alias("_pos", "_v"))
         .where(F.col("_v").isNotNull()))
    pair, late, step = f"_pos < {k}", f"_pos = {k}", f"_pos = {k + 1}"
    open_ = f"({pair} AND NOT coalesce(_v + {size} - 1 + {lat} <= {w}, false))"
    x = x.selectExpr(
        *[q(c) for c in keep],
        f"CASE WHEN {pair} THEN 0 WHEN {late} THEN 1 ELSE 2 END AS _kind",
        f"CASE WHEN {pair} THEN _v END AS window_start_ms",
        f"CASE WHEN {pair} THEN _v + {size} WHEN {step} THEN _v END AS window_end_ms",
        *[f"CASE WHEN {pair} THEN {q(c)} END AS {q(c)}" for c in keys],
        f"CASE WHEN {pair} THEN CAST({q(truth_col)} AS {truth_type}) END AS _truth",
        f"CASE WHEN {open_} THEN {q(est_col)} END AS _est",
        f"CASE WHEN {open_} THEN 1 END AS _op",
        f"CASE WHEN {step} THEN m_after END AS _fire",
        f"CASE WHEN {late} THEN 1 END AS _late")
    g = materialize(x.groupBy(*keep, "_kind", "window_start_ms", "window_end_ms", *keys).agg(
        F.sum("_truth").alias("_truth"), F.sum("_est").alias("_est"), F.count("_op").alias("_nopen"),
        F.min("_fire").alias("_fire"), F.count("_late").alias("_nlate")))
    fires = firing(g.where("_kind <> 1"), "window_end_ms", "_fire", slide, keep).withColumnRenamed("_fire", "_fire_all")
    j = g.where("_kind < 2").drop("_fire").join(fires, [*keep, "window_end_ms"], "left")
    in_result = F.col("_nopen") > 0
    return j.select(
        *keep, "window_start_ms", *keys,
        F.coalesce(F.col("_truth").cast("double"), F.lit(0.0)).alias("true_tip"),
        F.coalesce(F.col("_est"), F.lit(0.0)).alias("est_tip"),
        (F.col("_kind") == 0).alias("in_truth"),
        in_result.alias("in_result"),
        F.when(in_result, F.coalesce(F.col("_fire_all") - F.col("window_end_ms"), F.lit(-1))).cast("long").alias("delay_ms"),
        F.when(in_result, F.col("_fire_all").isNull()).alias("flushed"),
        *([F.col("_nlate").alias("late_rows")] if late_counts else []))


def scored_summary(scored: DataFrame, group: list[str] = (), tolerance: float = 0.01) -> DataFrame:
    """Per group: accuracy metrics, key verdicts, average delay and late rows
    from a ``scored_windows(..., late_counts=True)`` table, in one aggregation."""
    keyrow = F.col("window_start_ms").isNotNull()
    d = F.when(keyrow & F.col("in_result") & ~F.col("flushed"), F.col("delay_ms"))
    return scored.groupBy(*group).agg(
        *metric_columns(tolerance, keyrow)[:7],
        F.coalesce(F.sum(d).cast("double") / F.count(d) / F.lit(60000.0), F.lit(0.0)).alias("avg_delay_min"),
        F.count(d).alias("n_delay"),
        F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"))
