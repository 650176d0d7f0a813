"""Disorder profile: per-key running max, row delay, tail trim, histogram.

``exact_quantile`` finds the blocks of values that hold the two neighbouring
ranks by counting and sorts those alone; it interpolates linearly, like
numpy/pandas ``quantile`` and SQL ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tardy.functions.columns import col_of, minutes_between
from tardy.operators.order import BLK, prefix_max, range_blocks
from tardy.session import materialize


def running_max_by_key(df: DataFrame, value: str, order_by: list[str], keys: list[str],
                       out: str = "max_seen_ms", n_blocks: int | None = None) -> DataFrame:
    """Running max (row included) per key in arrival order.

    Blocks split the arrival order, so a key holding most rows is still
    spread over many tasks: partitions are (block, key), carries per key are
    taken over the small (block, key) summary.
    """
    return prefix_max(df, value, order_by, by=keys, n_blocks=n_blocks, seq=None,
                      exclusive=None, inclusive=out)


def hour_of_day(ms) -> Column:
    return F.pmod(F.floor(col_of(ms) / F.lit(3_600_000)), F.lit(24))


def minute_of_hour(ms) -> Column:
    return F.pmod(F.floor(col_of(ms) / F.lit(60_000)), F.lit(60))


def lateness(df: DataFrame, ts_ms: str, max_seen_ms: str, same_window: str = "hour_of_day",
             out: str = "delay_minutes") -> DataFrame:
    """Minutes a row trails the running max; 0 when both fall in the same hour.

    ``hour_of_day`` compares the hour only (date ignored, as the profiled
    analysis did: a row exactly 24 h late reads 0); ``date_hour`` compares the
    whole hour and is the sound form.
    """
    if same_window == "hour_of_day":
        same = hour_of_day(ts_ms) == hour_of_day(max_seen_ms)
    elif same_window == "date_hour":
        same = F.floor(F.col(ts_ms) / F.lit(3_600_000)) == F.floor(F.col(max_seen_ms) / F.lit(3_600_000))
    else:
        raise ValueError("same_window is 'hour_of_day' or 'date_hour'")
    return df.withColumn(out, F.when(same, F.lit(0.0)).otherwise(minutes_between(max_seen_ms, ts_ms)))


def exact_quantile(df: DataFrame, rank_key: str, value: str, q: float, tie: str | None = None,
                   materialized: bool = False, n_blocks: int | None = None) -> Column:
    """Linear-interpolated ``q`` quantile of ``value``, as a literal column.

    ``rank_key`` is an integral column ordered like ``value`` (``value`` may be
    a scaled double of it; equal keys have equal values, so ``tie`` decides
    nothing).  Selection instead of ranking: the rows are counted by contiguous
    blocks of the key, and only the blocks that hold the two ranks around
    ``(n-1)*q`` are sorted, by distinct key with its number of rows, so a key
    that most rows share is no load.  ``materialized``: ``df`` is already a
    written table, read it directly.
    """
    import math

    base = df.where(F.col(value).isNotNull()).select(rank_key, value)
    if not materialized:
        base = materialize(base)
    blocked = range_blocks(base, [rank_key], n_blocks)
    n = blocked.stats["rows"]
    if n == 0:
        return F.lit(None).cast("double")
    pos = (n - 1) * float(q)
    ranks = [math.floor(pos), min(math.floor(pos) + 1, n - 1)]
    before, held = 0, {}                         # block -> rows before it
    for r in sorted(blocked.df.groupBy(BLK).agg(F.count(F.lit(1)).alias("n")).collect()):
        if any(before <= k < before + r["n"] for k in ranks):
            held[r[BLK]] = before
        before += r["n"]
    start = F.coalesce(*[F.when(F.col(BLK) == b, F.lit(v)) for b, v in held.items()])
    keys = blocked.df.where(F.col(BLK).isin(*held)).groupBy(BLK, rank_key).agg(F.min(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(BLK).orderBy(rank_key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = keys.select("_v", "_n", (start + F.sum("_n").over(upto)).alias("_end"))
    hit = F.lit(False)
    for k in ranks:
        hit = hit | ((F.col("_end") > k) & (F.col("_end") - F.col("_n") <= k))
    found = keys.where(hit).collect()
    lo, hi = (next(float(r["_v"]) for r in found if r["_end"] - r["_n"] <= k < r["_end"]) for k in ranks)
    return F.lit(lo + (hi - lo) * (pos - ranks[0]))


def trim_tail(df: DataFrame, rank_key: str, value: str, q: float = 0.99, tie: str | None = None,
              materialized: bool = False, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Keep rows with ``value <= quantile(q)``.

    ``exact``: by selection, distributed (see :func:`exact_quantile`);
    otherwise one ``percentile_approx`` sketch pass (rank error ~1/accuracy).
    """
    if exact:
        cut = exact_quantile(df, rank_key, value, q, tie, materialized)
    else:
        cut = F.lit(df.select(F.percentile_approx(value, float(q), accuracy)).first()[0])
    return df.where(F.col(value) <= cut)


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed.  Rows: bin, lo, n."""
    r = df.agg(F.min(value).alias("mn"), F.max(value).alias("mx")).first()
    if r["mn"] is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, lo double")
    mn, mx = F.lit(r["mn"]), F.lit(r["mx"])
    width = (mx - mn).cast("double") / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col(value) - mn) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (df.where(F.col(value).isNotNull())
            .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("lo", mn + F.col("bin") * width))


def lateness_profile(df: DataFrame, ts_ms: str, order_by: list[str], keys: list[str], tie: str,
                     q: float = 0.99, min_delay_min: float = 0.1, same_window: str = "hour_of_day") -> DataFrame:
    """Rows trailing their key's running max by more than ``min_delay_min``
    minutes, tail above the ``q`` quantile cut; with the minute of the max."""
    x = running_max_by_key(df, ts_ms, order_by, keys)
    x = lateness(x, ts_ms, "max_seen_ms", same_window)
    late = materialize(x.where(F.col("delay_minutes") > F.lit(min_delay_min))
                       .withColumn("_dms", F.col("max_seen_ms") - F.col(ts_ms)))
    kept = trim_tail(late, "_dms", "delay_minutes", q, tie, materialized=True)
    return kept.withColumn("max_seen_minute", minute_of_hour("max_seen_ms").cast("int")).drop("_dms")
