"""Live replay with Structured Streaming.

Native ``withWatermark`` differs from the contract (the late test uses the
previous micro-batch's watermark, late rows are dropped rather than split
out, the last windows are never emitted and no firing delay is exposed), so
the exact live path is a ``foreachBatch`` sink:

* each micro-batch is annotated with the block-wise prefix max, plus the
  state carried from the batch before: rows so far, the last emitted max and
  each extractor lane's max (``emit_every`` and ``lanes`` work live too);
* annotated rows go to ``<out>/annotated/batch_id=N`` (overwrite), late and
  on-time rows optionally to two more outputs;
* the new carry is written to ``<out>/carry/batch_id=N``.  A retried batch
  reads the carry of ``N-1`` again, so it rewrites the same rows.

Results are computed from the annotated table with the batch operators, so
live and replay give the same answer.  Batches must arrive in arrival order
(for the file source: files taken oldest first, one or more per trigger);
within a batch the order columns decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tardy.operators.late import mark_late
from tardy.operators.watermark import annotate_watermark, with_bound


@dataclass
class LiveReplay:
    out_dir: str
    ts_ms: str
    order_by: list
    bound_ms: int
    size_ms: int | None = None          # set to also split late rows per batch
    slide_ms: int | None = None
    n_blocks: int | None = None
    emit_every: int = 1
    lanes: int = 1

    def _carry_path(self, batch_id: int) -> str:
        return f"{self.out_dir}/carry/batch_id={batch_id}"

    def _read_carry(self, spark: SparkSession, batch_id: int):
        """(last emitted max, rows so far, each lane's max) after batch N-1."""
        if batch_id == 0:
            return None, 0, [None] * self.lanes
        row = spark.read.parquet(self._carry_path(batch_id - 1)).first()
        return row["emitted"], row["rows"], list(row["lane_max"])

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        emitted, carry_rows, lane_max = self._read_carry(spark, batch_id)
        ann = annotate_watermark(batch, self.ts_ms, list(self.order_by), self.bound_ms,
                                 emit_every=self.emit_every, lanes=self.lanes, n_blocks=self.n_blocks,
                                 carry_max=emitted, carry_rows=carry_rows,
                                 carry_lanes=lane_max if (self.lanes > 1 or self.emit_every > 1) else None)
        ann.write.mode("overwrite").parquet(f"{self.out_dir}/annotated/batch_id={batch_id}")
        written = spark.read.parquet(f"{self.out_dir}/annotated/batch_id={batch_id}")
        if self.size_ms:
            flagged = mark_late(written, self.ts_ms, self.size_ms, self.slide_ms)
            flagged.where(~F.col("is_late")).drop("is_late").write.mode("overwrite") \
                .parquet(f"{self.out_dir}/on_time/batch_id={batch_id}")
            flagged.where(F.col("is_late")).drop("is_late").write.mode("overwrite") \
                .parquet(f"{self.out_dir}/late/batch_id={batch_id}")
        p = self.lanes
        new = written.agg(F.max("m_after").alias("e"), F.count(F.lit(1)).alias("n"),
                          *[F.max(F.when(F.pmod(F.col("seq"), F.lit(p)) == j, F.col(self.ts_ms))).alias(f"l{j}")
                            for j in range(p)]).first()
        lanes_now = [v for v in (max((x for x in (old, new[f"l{j}"]) if x is not None), default=None)
                                 for j, old in enumerate(lane_max))]
        e = max((x for x in (emitted, new["e"]) if x is not None), default=None)
        spark.createDataFrame([(e, carry_rows + new["n"], lanes_now)],
                              "emitted long, rows long, lane_max array<long>") \
            .coalesce(1).write.mode("overwrite").parquet(self._carry_path(batch_id))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
        return w.start()

    def annotated(self, spark: SparkSession) -> DataFrame:
        """All annotated rows so far (``batch_id`` column from the folder name)."""
        ann = spark.read.parquet(f"{self.out_dir}/annotated")
        # the stored span metadata describes one batch only: drop it
        ann = ann.withColumn("t_min_ms", F.col("t_min_ms").alias("t_min_ms", metadata={}))
        return with_bound(ann, self.bound_ms)


def write_arrival_files(df: DataFrame, order_by: list, out_dir: str, files: int) -> list[str]:
    """Lay a table out as ``files`` parquet files in arrival order, oldest first.

    Rows are range-partitioned on the order columns (contiguous ranges), one
    file per range; modification times are then set increasing through the
    Hadoop file system so the file source takes them in order.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by) \
        .write.mode("overwrite").parquet(out_dir)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(conf)
    names = sorted(st.getPath().toString() for st in fs.listStatus(path)
                   if st.getPath().getName().startswith("part-"))
    base = 1_600_000_000_000
    for i, n in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(n), base + i * 10_000, -1)
    return names


def native_window_stream(stream: DataFrame, ts_col: str, bound: str, size: str, slide: str | None,
                         keys: list[str], value: str) -> DataFrame:
    """Spark's own event-time windows (convenience, not the exact contract)."""
    # event time must be a zoned timestamp for withWatermark (NTZ is rejected)
    marked = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, bound)
    w = F.window(F.col(ts_col), size, slide) if slide else F.window(F.col(ts_col), size)
    return marked.groupBy(w.alias("window"), *keys).agg(F.sum(value).alias("sum_value"))


def proctime_window_stream(stream: DataFrame, keys: list[str], value: str, size: str = "2500 milliseconds",
                           slide: str = "500 milliseconds") -> DataFrame:
    """Keyed sum over sliding processing-time windows (the throughput job).

    The clock is stamped on arrival with ``current_timestamp()``; run it with
    ``outputMode('update')``.  For replayable tests use the batch operators
    with the arrival column as the clock.
    """
    return (stream.withColumn("_pt", F.current_timestamp())
            .groupBy(F.window("_pt", size, slide).alias("window"), *keys)
            .agg(F.sum(value).alias("total")))
