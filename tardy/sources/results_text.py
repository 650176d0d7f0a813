"""Window result text lines ``(start_ms,taxi,sum,delay)``.

Accepted forms: compact ``(1706742000000,2,31.0,3391000)`` and spaced
``(1706742000000, 2, 7.0, 3991000)``.  Blank lines, lines not wrapped in
parentheses and lines without four fields are skipped.  The fourth field
takes the rest of the line (split into at most four parts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_RE = r"^\((.*)\)$"


def parse_results(lines: DataFrame, text: str = "value", keep: tuple = ()) -> DataFrame:
    body = F.regexp_extract(F.trim(F.col(text)), LINE_RE, 1)
    parts = F.split(body, ",", 4)
    x = (lines.select(*[F.col(c) for c in keep], F.trim(F.col(text)).alias("_l"), parts.alias("_p"))
         .where(F.col("_l").startswith("(") & F.col("_l").endswith(")") & (F.size("_p") == 4)))
    return x.select(*[F.col(c) for c in keep],
                    F.trim(F.col("_p")[0]).cast("long").alias("window_start_ms"),
                    F.trim(F.col("_p")[1]).alias("taxi_id"),
                    F.trim(F.col("_p")[2]).cast("double").alias("sum_tip"),
                    F.trim(F.col("_p")[3]).cast("long").alias("delay_ms"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result text files with their line order (``src_file``, ``line_no``).

    Text has no stored row position; within one file the scan keeps file
    order, so a monotonically increasing id taken right after the scan
    orders lines of the same file.
    """
    raw = spark.read.text(path).select(
        "value", F.input_file_name().alias("src_file"),
        F.monotonically_increasing_id().alias("line_no"))
    return parse_results(raw, keep=("src_file", "line_no"))


def last_per_key(df: DataFrame, keys: list[str], order_by: list[str],
                 values: list[str] = ("sum_tip", "delay_ms")) -> DataFrame:
    """Last line wins per key (dict overwrite), as a partial+final aggregate."""
    o = F.struct(*[F.col(c) for c in order_by])
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in values]), o).alias("_last"))
    return got.select(*keys, *[F.col("_last")[c].alias(c) for c in values])
