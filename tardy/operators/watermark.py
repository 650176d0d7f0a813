"""Bounded-disorder watermark, replayed over a table in arrival order.

Contract (row ``i`` in arrival order, ``t`` its event ms, ``B`` the bound):

* ``mp_i`` is the largest event time among rows *before* ``i`` (null for the
  first row) and the row sees the watermark ``wm_i = mp_i - B``;
* with ``emit_every=n`` the watermark only moves every ``n`` rows: row ``i``
  sees the max over rows before ``n*floor(i/n)``;
* with ``lanes=p`` rows are dealt round robin (``seq % p``) to ``p``
  extractors, each tracks its own max, and the visible value is the smallest
  of them (null until every lane has seen a row).

Output columns added to the input:

``seq`` dense arrival position, ``max_seen_ms`` max event time including the
row, ``m_vis`` the max behind the visible watermark, ``m_after`` the max behind
the watermark right after the row (what a window can fire on), ``t_min_ms``
the smallest event time of the table, ``wm_ms``.

The prefix max does not depend on ``B``: annotate once with ``bound_ms=None``
and derive watermarks for many bounds with :func:`with_bound`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tardy.operators.order import BLK, _carry, _span_meta, prefix_max, range_blocks


def annotate_watermark(df: DataFrame, ts_ms: str, order_by: list[str],
                       bound_ms: int | None = None, emit_every: int = 1, lanes: int = 1,
                       n_blocks: int | None = None, carry_max: int | None = None,
                       carry_rows: int = 0, carry_lanes: list | None = None) -> DataFrame:
    """Carry-in for live micro-batches (state of everything that arrived
    before ``df``): ``carry_rows`` rows, ``carry_max`` the last emitted max
    (the max event time when ``emit_every=lanes=1``), ``carry_lanes`` each
    lane's max.  Default: nothing arrived before."""
    if emit_every < 1 or lanes < 1:
        raise ValueError("emit_every and lanes must be >= 1")
    if dict(df.dtypes).get(ts_ms) not in ("bigint", "int"):
        raise ValueError(f"event time {ts_ms!r} must be integral epoch ms (functions.to_epoch_ms converts "
                         "timestamps)")
    if emit_every == 1 and lanes == 1:
        out = prefix_max(df, ts_ms, order_by, n_blocks=n_blocks, seq="seq",
                         exclusive="m_vis", inclusive="max_seen_ms", global_min="t_min_ms")
        if carry_max is not None:
            c = F.lit(int(carry_max)).cast("long")
            out = (out.withColumn("m_vis", F.greatest(c, F.col("m_vis")))
                   .withColumn("max_seen_ms", F.greatest(c, F.col("max_seen_ms"))))
        if carry_rows:
            out = out.withColumn("seq", F.col("seq") + F.lit(int(carry_rows)))
        out = out.withColumn("m_after", F.col("max_seen_ms"))
    else:
        out = _annotate_general(df, ts_ms, order_by, emit_every, lanes, n_blocks,
                                carry_rows, carry_lanes, carry_max)
    return with_bound(out, bound_ms) if bound_ms is not None else out


def with_bound(ann: DataFrame, bound_ms: int, col: str = "wm_ms") -> DataFrame:
    return ann.withColumn(col, F.col("m_vis") - F.lit(int(bound_ms)))


def _annotate_general(df: DataFrame, t: str, order_by: list[str], n: int, p: int,
                      n_blocks: int | None, carry_rows: int = 0, carry_lanes: list | None = None,
                      carry_emitted: int | None = None) -> DataFrame:
    """Lanes and/or emission every n rows, with one sort of the data.

    Pass 1 (one shuffle by block, one sort): dense ``seq``; per lane the
    running max inside the block (``_l{j}``) and its value at the last
    emission row before the row (``_p{j}``).  The result is written once to
    the checkpoint folder.  Per-block summaries (lane maxima, lane maxima at
    the block's last emission row) give, on the small block table, each
    block's lane carries and the last emitted value before it.  Pass 2 is a
    broadcast join plus column expressions: no second shuffle or sort.
    """
    from tardy.session import materialize

    b = range_blocks(df, order_by, n_blocks, stat_col=t)
    data = b.df
    counts = data.groupBy(BLK).agg(F.count(F.lit(1)).alias("_bcnt"), F.min(t).alias("_bmin"))
    offsets = F.broadcast(_carry(counts, [], [], "_bcnt", whole_min={"_bmin": "t_min_ms"}))  # one row per block
    w = Window.partitionBy(BLK).orderBy(*order_by)
    run_incl = w.rowsBetween(Window.unboundedPreceding, 0)
    run_excl = w.rowsBetween(Window.unboundedPreceding, -1)
    lanes = list(range(p))

    x = (data.join(offsets, BLK, "left")
         .withColumn("seq", (F.col("_coff") + F.lit(int(carry_rows)) + F.row_number().over(w) - 1).cast("long"))
         .drop("_coff")
         .withColumn("_emit", F.pmod(F.col("seq") + 1, F.lit(n)) == 0))
    for j in lanes:
        val = F.when(F.pmod(F.col("seq"), F.lit(p)) == j, F.col(t)) if p > 1 else F.col(t)
        x = x.withColumn(f"_l{j}", F.max(val).over(run_incl))
    # lane maxima are non-decreasing, so "value at the last emission row" is a max
    for j in lanes:
        x = x.withColumn(f"_p{j}", F.max(F.when(F.col("_emit"), F.col(f"_l{j}"))).over(run_excl))
    x = x.withColumn("_pany", F.max(F.when(F.col("_emit"), F.lit(1))).over(run_excl))
    x = materialize(x)

    summ = x.groupBy(BLK).agg(*[F.max(f"_l{j}").alias(f"_bm{j}") for j in lanes],
                              *[F.max(F.when(F.col("_emit"), F.col(f"_l{j}"))).alias(f"_le{j}") for j in lanes],
                              F.max(F.when(F.col("_emit"), F.lit(1))).alias("_hase"))
    before = Window.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    init = list(carry_lanes or []) + [None] * p
    carry = summ.select(BLK, "_hase", *[f"_le{j}" for j in lanes],
                        *[F.greatest(F.lit(init[j]).cast("long"), F.max(f"_bm{j}").over(before)).alias(f"_c{j}")
                          for j in lanes])

    def combined(parts):
        """Smallest lane value; null while any lane has none."""
        any_null = F.lit(False)
        for e in parts:
            any_null = any_null | e.isNull()
        return F.when(any_null, F.lit(None).cast("long")).otherwise(F.least(*parts) if p > 1 else parts[0])

    last_emit = F.when(F.col("_hase") == 1, combined([F.greatest(F.col(f"_c{j}"), F.col(f"_le{j}")) for j in lanes]))
    carry = (carry.withColumn("_eb", last_emit)
             .withColumn("_cem", F.greatest(F.lit(carry_emitted).cast("long"), F.max("_eb").over(before)))
             .select(BLK, "_cem", *[f"_c{j}" for j in lanes]))

    g = [F.greatest(F.col(f"_c{j}"), F.col(f"_l{j}")) for j in lanes]
    prev = combined([F.greatest(F.col(f"_c{j}"), F.col(f"_p{j}")) for j in lanes])
    z = (x.join(F.broadcast(carry), BLK, "left")
         .withColumn("max_seen_ms", F.greatest(*g) if p > 1 else g[0])
         .withColumn("_em", F.when(F.col("_emit"), combined(g)))
         .withColumn("m_vis", F.greatest(F.col("_cem"), F.when(F.col("_pany") == 1, prev)))
         .withColumn("m_after", F.coalesce(F.col("_em"), F.col("m_vis"))))
    if carry_lanes:   # the overall max also covers earlier batches
        z = z.withColumn("max_seen_ms", F.greatest(F.col("max_seen_ms"),
                                                   *[F.lit(v).cast("long") for v in carry_lanes]))
    z = z.drop("_em", "_emit", "_pany", "_cem", *[f"_{k}{j}" for k in ("l", "p", "c") for j in lanes])
    z = z.withColumn("t_min_ms", F.col("t_min_ms").alias("t_min_ms", metadata=_span_meta(b.stats)))
    return z.drop(BLK)
