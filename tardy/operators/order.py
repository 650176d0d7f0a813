"""Global arrival order without a single task.

A running maximum "in arrival order" has no partition key, so a plain
``max(...) OVER (ORDER BY seq)`` moves every row into one task.  This module
splits the order into contiguous *blocks* and runs the prefix computation in
two passes:

1. every row gets a block id that is monotone in the order; block bounds are
   sampled once and then applied as a pure column expression, so retries,
   recomputation and AQE can never move a row to another block;
2. a small per-block summary (count, max) gives each block its carry-in
   (rows and maximum of all earlier blocks); it has one row per block, so
   its size is bounded by ``n_blocks`` and it is broadcast;
3. inside a block the prefix is an ordinary window partitioned by block, and
   the global value is ``greatest(carry, local)``.

Bounds are pairs (leading key, tie-breaker), null being a value that sorts
first: ties of the leading column, and rows that have none, are split by the
second one, so one hot arrival instant (even half of all rows) is spread over
many blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLK = "_blk"

# Keys of the sample that bounds are picked from: 64 for each block, fewer (8 at
# least) past this many in all.  Blocks then vary more in size; their number
# follows the rows without a cap.
SAMPLE_KEYS = 4_000_000
DEFAULT_ROWS_PER_BLOCK = 2_000_000
#: what null keys read as: below every value that a key may have
NULL_LEAD, NULL_TIE = -(2 ** 53), -(2 ** 63)
INTEGRAL = ("bigint", "int", "smallint", "tinyint")


@dataclass
class Blocked:
    df: DataFrame          # input plus BLK
    n_blocks: int          # number of block ids in use (0..n_blocks-1)
    stats: dict | None = None   # rows, and min/max of ``stat_col`` when asked


def _default_blocks(spark, total: int, rows_per_block: int) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    by_size = math.ceil(total / max(1, rows_per_block))
    return max(1, 4 * parts, by_size)


def range_blocks(df: DataFrame, order_by: list[str], n_blocks: int | None = None,
                 rows_per_block: int = DEFAULT_ROWS_PER_BLOCK,
                 sample_per_block: int = 64, seed: int = 20240131,
                 stat_col: str | None = None) -> Blocked:
    """Add ``_blk``: contiguous, monotone ranges of ``order_by``.

    ``order_by`` is one or two numeric columns (leading key below 2**53 in
    magnitude, e.g. epoch ms or a row counter; optional tie-breaker) that
    together identify a row: a replay over a non-unique order is not
    deterministic.  Nulls sort first; rows with a null leading key are split by
    the tie-breaker like those of any other value.
    """
    if not 1 <= len(order_by) <= 2:
        raise ValueError("order_by takes one numeric key and an optional tie-breaker")
    spark = df.sparkSession
    p_col = order_by[0]
    s_col = order_by[1] if len(order_by) == 2 else None
    types = dict(df.dtypes)
    for c in order_by:
        if types.get(c) not in INTEGRAL:
            raise ValueError(f"order column {c!r} must be integral (got {types.get(c)}): "
                             "use epoch ms, a row position or an integer rank")

    if stat_col:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.min(stat_col).alias("lo"), F.max(stat_col).alias("hi")).first()
        total, stats = r["n"], {"rows": r["n"], "min": r["lo"], "max": r["hi"]}
    else:
        total = df.count()
        stats = {"rows": total}
    if n_blocks is None:
        n_blocks = _default_blocks(spark, total, rows_per_block)
    n_blocks = max(1, min(int(n_blocks), max(1, total)))
    if n_blocks == 1 or total == 0:
        return Blocked(df.withColumn(BLK, F.lit(0)), 1, stats)

    # Sample the order keys (bounded size), pick n_blocks-1 bounds on the driver.
    # the sample follows the number of blocks, so blocks stay even at any size
    per_block = max(8, min(sample_per_block, SAMPLE_KEYS // n_blocks))
    frac = min(1.0, n_blocks * per_block / total)
    lead = F.coalesce(F.col(p_col).cast("long"), F.lit(NULL_LEAD))
    keys = [lead.alias("p")]
    if s_col:
        keys.append(F.coalesce(F.col(s_col).cast("long"), F.lit(NULL_TIE)).alias("s"))
    smp = df.select(*keys)
    if frac < 1.0:
        smp = smp.sample(False, frac, seed)
    pdf = smp.toPandas()
    if len(pdf) == 0:
        return Blocked(df.withColumn(BLK, F.lit(0)), 1, stats)
    sort_cols = ["p", "s"] if s_col else ["p"]
    pdf = pdf.sort_values(sort_cols, kind="mergesort").reset_index(drop=True)
    m = len(pdf)
    picks = sorted({(i * m) // n_blocks for i in range(1, n_blocks)})
    bounds = []
    for i in picks:
        b = tuple(int(v) for v in pdf.loc[i, sort_cols])
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    if not bounds:
        return Blocked(df.withColumn(BLK, F.lit(0)), 1, stats)

    # Group bounds by leading value: u_1 < ... < u_k, each with its tie list.
    leads: list[int] = []
    ties: list[list[int]] = []
    for b in bounds:
        if not leads or leads[-1] != b[0]:
            leads.append(b[0])
            ties.append([])
        if s_col:
            ties[-1].append(b[1])
    rows = [(0, None, 0, 0, [])]
    seen = 0
    for i, (u, tl) in enumerate(zip(leads, ties), start=1):
        width = len(tl) if s_col else 1
        rows.append((i, u, seen, seen + width, tl))
        seen += width
    schema = T.StructType([
        T.StructField("_bk", T.IntegerType(), False),
        T.StructField("_bu", T.LongType(), True),
        T.StructField("_bprev", T.IntegerType(), False),
        T.StructField("_ble", T.IntegerType(), False),
        T.StructField("_bties", T.ArrayType(T.LongType()), False),
    ])
    lookup = spark.createDataFrame(rows, schema)

    real = [v for v in leads if v != NULL_LEAD]
    if real and max(abs(real[0]), abs(real[-1])) >= 2 ** 53:
        raise ValueError(f"order column {p_col!r} holds values beyond 2**53; rebase it first")
    splits = [float("-inf")] + [float(u) for u in leads] + [float("inf")]
    tmp = "_bkd"
    with_p = df.withColumn(tmp, lead.cast("double"))
    bucketed = (Bucketizer(splits=splits, inputCol=tmp, outputCol="_bkf").transform(with_p)
                .withColumn("_bk", F.col("_bkf").cast("int")).drop("_bkf", tmp))
    joined = bucketed.join(F.broadcast(lookup), "_bk", "left")
    if s_col:
        # how many of a leading value's bounds are not over the row, by halving
        tie = F.coalesce(F.col(s_col).cast("long"), F.lit(NULL_TIE))
        joined = joined.withColumn("_bpos", F.lit(0))
        for k in range(max(map(len, ties), default=0).bit_length() - 1, -1, -1):
            probe = F.get("_bties", F.col("_bpos") + F.lit((1 << k) - 1))
            joined = joined.withColumn("_bpos", F.col("_bpos") + F.when(probe <= tie, F.lit(1 << k)).otherwise(F.lit(0)))
        blk = F.when(lead == F.col("_bu"), F.col("_bprev") + F.col("_bpos")).otherwise(F.col("_ble"))
    else:
        blk = F.col("_ble")
    out = joined.withColumn(BLK, blk.cast("int")).drop("_bk", "_bu", "_bprev", "_ble", "_bties", "_bpos")
    return Blocked(out, seen + 1, stats)


def _carry(summary: DataFrame, by: list[str], max_cols: list[str], count_col: str | None,
           min_cols: list[str] = (), whole_min: dict | None = None) -> DataFrame:
    """Exclusive running max (and row offset) over blocks of a small table;
    ``whole_min`` {col: out}: min over all blocks of the group."""
    w = Window.partitionBy(*by).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.max(c).over(w).alias("_c" + c) for c in max_cols]
    cols += [F.min(c).over(w).alias("_c" + c) for c in min_cols]
    whole = Window.partitionBy(*by).orderBy(BLK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols += [F.min(c).over(whole).alias(o) for c, o in (whole_min or {}).items()]
    if count_col:
        cols.append(F.coalesce(F.sum(count_col).over(w), F.lit(0)).alias("_coff"))
    return summary.select(BLK, *by, *cols)


def prefix_max(df: DataFrame, value: str, order_by: list[str], by: tuple | list = (),
               n_blocks: int | None = None, seq: str | None = "seq",
               exclusive: str | None = "mp", inclusive: str | None = "mx",
               blocked: Blocked | None = None, keep_block: bool = False,
               global_min: str | None = None) -> DataFrame:
    """Running max of ``value`` in the order of ``order_by`` (per ``by`` group).

    ``exclusive``: max over earlier rows only (null for the first row);
    ``inclusive``: max over earlier rows and the row itself;
    ``seq``: dense 0-based position in the order (per ``by`` group).
    ``global_min``: also add the smallest ``value`` of the whole group (taken
    from the same per-block summary, no extra scan).
    Null ``value`` rows occupy a position but do not change the max.
    """
    by = list(by)
    b = blocked or range_blocks(df, order_by, n_blocks, stat_col=value if global_min and not by else None)
    data = b.df
    summary = data.groupBy(BLK, *by).agg(F.max(value).alias("_bmax"), F.count(F.lit(1)).alias("_bcnt"),
                                         F.min(value).alias("_bmin"))
    carry = _carry(summary, by, ["_bmax"], "_bcnt", whole_min={"_bmin": global_min} if global_min else None)
    if not by:
        # one row per block
        carry = F.broadcast(carry)

    w = Window.partitionBy(BLK, *by).orderBy(*order_by)
    out = data
    if exclusive:
        out = out.withColumn("_lmp", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if inclusive:
        out = out.withColumn("_lmx", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if seq:
        out = out.withColumn("_rn", F.row_number().over(w))
    out = out.join(carry, [BLK, *by], "left")
    if exclusive:
        out = out.withColumn(exclusive, F.greatest(F.col("_c_bmax"), F.col("_lmp")))
    if inclusive:
        out = out.withColumn(inclusive, F.greatest(F.col("_c_bmax"), F.col("_lmx")))
    if seq:
        out = out.withColumn(seq, (F.coalesce(F.col("_coff"), F.lit(0)) + F.col("_rn") - 1).cast("long"))
    out = out.drop("_lmp", "_lmx", "_rn", "_c_bmax", "_coff")
    if global_min and b.stats and "min" in b.stats:
        out = out.withColumn(global_min, F.col(global_min).alias(global_min, metadata=_span_meta(b.stats)))
    return out if keep_block else out.drop(BLK)


def _span_meta(stats: dict) -> dict:
    lo, hi = stats.get("min"), stats.get("max")
    return {"min": lo, "max": hi, "span": (hi - lo) if lo is not None and hi is not None else 0}


def dense_seq(df: DataFrame, order_by: list[str], seq: str = "seq",
              n_blocks: int | None = None, keep_block: bool = False) -> DataFrame:
    """Dense 0-based row number in the order of ``order_by``, computed per block."""
    b = range_blocks(df, order_by, n_blocks)
    counts = b.df.groupBy(BLK).agg(F.count(F.lit(1)).alias("_bcnt"))
    carry = F.broadcast(_carry(counts, [], [], "_bcnt"))
    w = Window.partitionBy(BLK).orderBy(*order_by)
    out = (b.df.withColumn("_rn", F.row_number().over(w)).join(carry, BLK, "left")
           .withColumn(seq, (F.col("_coff") + F.col("_rn") - 1).cast("long"))
           .drop("_rn", "_coff"))
    return out if keep_block else out.drop(BLK)
