"""Generated keyed load, as Spark jobs.

``gen_rows(spark, n, fn)`` produces all ids ``0..n-1`` (the remainder ids
``n % partitions`` included) through a column function; ``gen_keyed`` is
``(id % keys, 1)``.  ``keyed_from`` derives the same load from a table so its
size grows with the data: ``fanout`` ids per source row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gen_rows(spark: SparkSession, n: int, fn: Callable[[Column], Column | list[Column]],
             partitions: int | None = None) -> DataFrame:
    ids = spark.range(0, int(n), 1, partitions) if partitions else spark.range(0, int(n))
    out = fn(F.col("id"))
    return ids.select(*(out if isinstance(out, (list, tuple)) else [out]))


def gen_keyed(spark: SparkSession, n: int, keys: int = 10_000, partitions: int | None = None) -> DataFrame:
    return gen_rows(spark, n, lambda i: [F.pmod(i, F.lit(keys)).alias("key"), F.lit(1).cast("long").alias("one")],
                    partitions)


def keyed_from(df: DataFrame, id_col: str, keys: int = 10_000, fanout: int = 20) -> DataFrame:
    """``fanout`` generated ids per row (``id*fanout + j``), keyed ``% keys``."""
    j = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))
    x = df.select(F.col(id_col).cast("long").alias("_id"), j.alias("_j"))
    gid = F.col("_id") * F.lit(fanout) + F.col("_j")
    return x.select(gid.alias("gen_id"), F.pmod(gid, F.lit(keys)).alias("key"), F.lit(1).cast("long").alias("one"))
