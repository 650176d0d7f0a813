"""Sinks: result lines as text, on-time/late split outputs, discard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tardy.functions.columns import adjust_delay_col


def result_line(spaced: bool = False) -> Column:
    """``(start,taxi,sum,delay)``; spaced form ``(start, taxi, sum, delay)``."""
    fmt = "(%d, %s, %s, %d)" if spaced else "(%d,%s,%s,%d)"
    return F.format_string(fmt, F.col("window_start_ms"), F.col("taxi_id"),
                           F.col("sum_tip").cast("string"), F.col("delay_ms"))


def format_results(df: DataFrame, spaced: bool = False) -> DataFrame:
    """One text line per result row; rows with a null field are skipped."""
    ok = F.lit(True)
    for c in ("window_start_ms", "taxi_id", "sum_tip", "delay_ms"):
        ok = ok & F.col(c).isNotNull()
    return df.where(ok).select(result_line(spaced).alias("line"))


def write_results(df: DataFrame, path: str, spaced: bool = False, fmt: str = "text") -> None:
    """Overwrite ``path`` (a directory).  ``fmt='parquet'`` keeps the columns."""
    if fmt == "text":
        format_results(df, spaced).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def adjust_delay(df: DataFrame, add_ms: int, col: str = "delay_ms") -> DataFrame:
    """Add a fixed amount to non-negative delays (flush markers stay -1)."""
    return df.withColumn(col, adjust_delay_col(col, add_ms))


def rewrite_results(df: DataFrame, add_ms: int, out_path: str) -> None:
    """Shift delays and write the spaced form to a *new* path (never the input)."""
    write_results(adjust_delay(df, add_ms), out_path, spaced=True)


def write_split(annotated: DataFrame, late_col: str, on_time_path: str, late_path: str,
                fmt: str = "parquet") -> None:
    """Two outputs from one annotated table: on-time rows and late rows."""
    annotated.where(~F.col(late_col)).drop(late_col).write.mode("overwrite").format(fmt).save(on_time_path)
    annotated.where(F.col(late_col)).drop(late_col).write.mode("overwrite").format(fmt).save(late_path)


def discard(df: DataFrame) -> None:
    """Run the plan and drop the rows (throughput runs)."""
    df.write.format("noop").mode("overwrite").save()
