"""Live windows: every micro-batch emits the windows it closes, once.

:class:`LiveWindows` is a ``foreachBatch`` sink.  For batch N it writes

* ``rows/batch_id=N``: the annotated rows, in one write split by ``is_late``;
* ``late/batch_id=N``: the late rows, each with the running late count;
* ``windows/batch_id=N``: by ``role`` the windows that fired (``first``), their
  later changes within the allowed lateness (``update``), and what stays open
  (``open``): partial aggregates of windows that have not fired or may change;
* ``merged`` (and ``judged``): what the batch reads more than once, overwritten
  by the next;
* ``commits/batch_id=N``, last: the manifest of the batch, which is also the
  state the next batch starts from (rows so far, largest event time behind the
  watermark, each lane's, late rows so far).

Batch N reads the open windows and the manifest of N - 1 only, so its cost
follows the batch and the open windows, not what was stored before.  Readers
follow the manifests: a batch that failed half-way is not seen, neither of its
outputs, and a retried batch writes the same rows again.  A batch whose
manifest exists is not written twice.  :meth:`LiveWindows.finish` closes the
input: windows still open fire then, flagged ``flushed``.

Batches must come in arrival order; within a batch the order columns decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tardy.operators.late import firing, late_flag
from tardy.operators.updates import AFTER, EARLY, STEP, Agg, row_pairs, running
from tardy.operators.watermark import annotate_watermark

MANIFEST = "last_batch long, emitted long, rows long, lane_max array<long>, late_rows long, final boolean"


@dataclass
class LiveWindows:
    out_dir: str
    #: columns of a (prepared) batch
    schema: T.StructType
    ts_ms: str
    order_by: list
    bound_ms: int
    size_ms: int
    keys: list
    aggs: list
    slide_ms: int | None = None
    allowed_lateness_ms: int = 0
    emit_every: int = 1
    lanes: int = 1
    n_blocks: int | None = None
    #: applied to every batch first, e.g. to add the order columns
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda batch: batch)

    # --- manifests -----------------------------------------------------------

    def _path(self, kind: str, batch_id: int | None = None) -> str:
        return f"{self.out_dir}/{kind}" + ("" if batch_id is None else f"/batch_id={batch_id}")

    def _manifest(self, spark: SparkSession, batch_id: int):
        """The manifest of a batch, or None if it was not committed."""
        found = _read(spark, self._path("commits", batch_id), MANIFEST)
        return found.first() if found is not None else None

    def _commit(self, spark: SparkSession, batch_id: int, emitted, rows, lane_max, late_rows, final: bool = False) -> None:
        made = spark.createDataFrame([(batch_id, emitted, rows, lane_max, late_rows, final)], MANIFEST)
        made.coalesce(1).write.mode("overwrite").parquet(self._path("commits", batch_id))

    # --- one batch -----------------------------------------------------------

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._manifest(spark, batch_id)
        if done is not None:
            if done["final"]:
                raise ValueError("the input was closed: start a new output folder")
            return
        old = self._manifest(spark, batch_id - 1) if batch_id else None
        if batch_id and old is None:
            raise ValueError(f"batch {batch_id} before batch {batch_id - 1} was committed")
        emitted, rows, late_rows = (old["emitted"], old["rows"], old["late_rows"]) if old else (None, 0, 0)
        lane_max = list(old["lane_max"]) if old else [None] * self.lanes
        general = self.lanes > 1 or self.emit_every > 1
        ann = annotate_watermark(self.prepare(batch), self.ts_ms, list(self.order_by), self.bound_ms, emit_every=self.emit_every,
                                 lanes=self.lanes, n_blocks=self.n_blocks, carry_max=emitted, carry_rows=rows,
                                 carry_lanes=lane_max if general else None)
        flag = late_flag(self.ts_ms, self.size_ms, self.slide_ms, allowed_lateness_ms=self.allowed_lateness_ms)
        ann.drop("t_min_ms").withColumn("is_late", flag).write.mode("overwrite").partitionBy("is_late").parquet(self._path("rows", batch_id))
        written = self._table(spark, "rows", self._row_schema().add("is_late", "boolean"), batch_id)
        p = self.lanes
        new = written.agg(F.max("m_after").alias("e"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_late"), 1)).alias("late"),
                          *[F.max(F.when(F.pmod(F.col("seq"), F.lit(p)) == j, F.col(self.ts_ms))).alias(f"l{j}") for j in range(p)]).first()
        emitted = max((x for x in (emitted, new["e"]) if x is not None), default=None)
        lane_max = [max((x for x in (a, new[f"l{j}"]) if x is not None), default=None) for j, a in enumerate(lane_max)]

        numbered = running(written.where("is_late").drop("is_late"), [], [])
        (numbered.withColumn("late_count", F.col("_n") + F.lit(late_rows)).drop("_n")
         .write.mode("overwrite").parquet(self._path("late", batch_id)))
        wm = None if emitted is None else emitted - self.bound_ms
        self._windows(spark, written, batch_id, wm).write.mode("overwrite").partitionBy("role").parquet(self._path("windows", batch_id))
        self._commit(spark, batch_id, emitted, rows + new["n"], lane_max, late_rows + new["late"])

    def _open(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Windows that batch ``batch_id`` left open."""
        return self._table(spark, "windows", self._window_schema(), batch_id).where("role = 'open'").drop("role")

    def _table(self, spark: SparkSession, kind: str, schema: T.StructType, batch_id: int | None = None) -> DataFrame:
        """A written table, empty where nothing was written."""
        found = _read(spark, self._path(kind, batch_id), schema) if batch_id is None or batch_id >= 0 else None
        return found if found is not None else spark.createDataFrame([], schema)

    def _row_schema(self) -> T.StructType:
        out = T.StructType(list(self.schema.fields))
        for name in ("seq", "m_vis", "max_seen_ms", "m_after", "wm_ms"):
            out = out.add(name, "long")
        return out

    def _window_schema(self) -> T.StructType:
        out = T.StructType().add("window_start_ms", "long").add("window_end_ms", "long")
        for k in self.keys:
            out = out.add(k, self.schema[k].dataType)
        for a in self.aggs:
            out = out.add(a.name, self._agg_type(a))
        for name in ("fire_max_ms", "update", "delay_ms"):
            out = out.add(name, "long")
        return out.add("role", "string")

    def _agg_type(self, a: Agg) -> T.DataType:
        kind = self.schema[a.col].dataType if a.col else T.LongType()
        if a.fn == "count":
            return T.LongType()
        if a.fn != "sum":
            return kind
        if isinstance(kind, T.DecimalType):
            return T.DecimalType(min(38, kind.precision + 10), kind.scale)
        return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.LongType()

    def _windows(self, spark: SparkSession, written: DataFrame, batch_id: int, wm: int | None) -> DataFrame:
        """Fired, changed and open windows of a batch, told apart by ``role``."""
        names = [a.name for a in self.aggs]
        by = ["window_start_ms", "window_end_ms", *self.keys]
        values = sorted({a.col for a in self.aggs if a.col})
        pairs = row_pairs(written, self.ts_ms, self.keys, values, self.size_ms, self.slide_ms, self.bound_ms, self.allowed_lateness_ms)
        none = F.lit(None).cast("long")
        # rows and watermark steps join what was held in one pass, kept for the readers below
        fresh = pairs.where(F.col("_kind") != AFTER).select(
            "_kind", *by, *[a.of_row(self._agg_type(a)).alias(a.name) for a in self.aggs],
            F.when(F.col("_kind") == STEP, F.col("m_after")).alias("_fire"), none.alias("fire_max_ms"), F.lit(0).cast("long").alias("update"))
        held = self._open(spark, batch_id - 1).select(F.lit(EARLY).alias("_kind"), *by, *names, none.alias("_fire"), "fire_max_ms", "update")
        merged = self._kept(spark, "merged", held.unionByName(fresh).groupBy("_kind", *by).agg(
            *[a.of_parts().alias(a.name) for a in self.aggs], *[f(c).alias(c) for f, c in ((F.min, "_fire"), (F.max, "fire_max_ms"), (F.max, "update"))]))
        whole = merged.where(F.col("_kind") == EARLY).drop("_kind", "_fire")
        now = firing(merged.where("fire_max_ms is null").select("window_end_ms", "_fire"), "window_end_ms", "_fire", int(self.slide_ms or self.size_ms))
        # ``update``: rows of the log so far; a window that fires now has one
        judged = whole.join(now, "window_end_ms", "left").withColumn("_now", F.col("fire_max_ms").isNull() & F.col("_fire").isNotNull())
        judged = judged.select(*by, *names, F.coalesce("fire_max_ms", "_fire").alias("fire_max_ms"),
                               (F.col("update") + F.col("_now").cast("long")).alias("update"), "_now")
        out = ["window_start_ms", "window_end_ms", *self.keys, *names, "fire_max_ms", "update", "delay_ms", "role"]
        if not self.allowed_lateness_ms:                       # a window fires or stays open, never both
            return judged.withColumn("delay_ms", F.col("fire_max_ms") - F.col("window_end_ms")).withColumn("update", F.lit(0).cast("long")) \
                .withColumn("role", F.when(F.col("_now"), "first").otherwise("open")).select(*out)
        judged = self._kept(spark, "judged", judged)
        first = judged.where("_now").withColumn("delay_ms", F.col("fire_max_ms") - F.col("window_end_ms")) \
            .withColumn("update", F.lit(0).cast("long")).withColumn("role", F.lit("first"))
        base = judged.select(*by, *[F.col(n).alias("_b_" + n) for n in names], F.col("update").alias("_before"))
        late = running(pairs.where(F.col("_kind") == AFTER), by, self.aggs).join(base, by, "left")
        change = late.select(*by, *[a.joined("_b_" + a.name, a.name).alias(a.name) for a in self.aggs],
                             F.col("m_vis").alias("fire_max_ms"), (F.coalesce("_before", F.lit(0)) + F.col("_n") - 1).cast("long").alias("update"),
                             (F.col("m_vis") - F.col("window_end_ms")).alias("delay_ms"), F.lit("update").alias("role"))
        newest = change.groupBy(*by).agg(F.max_by(F.struct(*names), "update").alias("_v"), F.max("fire_max_ms").alias("_f"), F.max("update").alias("_u"))
        after = judged.drop("_now").join(newest, by, "full_outer").select(
            *by, *[F.when(F.col("_u").isNotNull(), F.col("_v")[n]).otherwise(F.col(n)).alias(n) for n in names],
            F.coalesce("fire_max_ms", "_f").alias("fire_max_ms"), F.coalesce(F.col("_u") + 1, "update").alias("update"))
        stays = F.col("fire_max_ms").isNull()
        if wm is not None:
            stays = stays | (F.col("window_end_ms") - 1 + F.lit(self.allowed_lateness_ms) > F.lit(wm))
        keep = after.where(stays).withColumn("delay_ms", none).withColumn("role", F.lit("open"))
        return first.select(*out).unionByName(change.select(*out)).unionByName(keep.select(*out))

    def _kept(self, spark: SparkSession, kind: str, made: DataFrame) -> DataFrame:
        """A table that this batch reads more than once, written once; the next
        batch overwrites it."""
        made.write.mode("overwrite").parquet(self._path(kind))
        return spark.read.schema(made.schema).parquet(self._path(kind))

    # --- the stream ------------------------------------------------------------

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()

    def finish(self, spark: SparkSession) -> None:
        """End of input: the windows that have not fired do now, flagged ``flushed``."""
        last = self._last(spark)
        if last is None or last["final"]:
            return
        n = last["last_batch"] + 1
        rest = self._open(spark, n - 1).where("fire_max_ms is null")
        (rest.withColumn("update", F.lit(0).cast("long")).withColumn("delay_ms", F.lit(-1).cast("long")).withColumn("role", F.lit("first"))
         .write.mode("overwrite").partitionBy("role").parquet(self._path("windows", n)))
        self._commit(spark, n, last["emitted"], last["rows"], last["lane_max"], last["late_rows"], final=True)

    # --- readers ---------------------------------------------------------------

    def commits(self, spark: SparkSession) -> DataFrame:
        """The manifests, one row per committed batch."""
        return self._table(spark, "commits", T.StructType.fromDDL(MANIFEST))

    def _last(self, spark: SparkSession):
        return self.commits(spark).orderBy(F.desc("last_batch")).first()

    def _committed(self, spark: SparkSession, kind: str, schema: T.StructType) -> DataFrame:
        """Rows of committed batches: their ids are one range, which is a
        partition filter."""
        last = self._last(spark)
        found = self._table(spark, kind, schema.add("batch_id", "long"))
        return found.where(F.col("batch_id") <= F.lit(last["last_batch"] if last else -1))

    def emitted(self, spark: SparkSession) -> DataFrame:
        """The log of windows: ``window_start_ms, keys, update, aggregates,
        delay_ms, flushed, batch_id``."""
        log = self._committed(spark, "windows", self._window_schema()).where(F.col("role") != "open")
        return log.select("window_start_ms", *self.keys, "update", *[a.name for a in self.aggs], "delay_ms",
                          F.col("fire_max_ms").isNull().alias("flushed"), "batch_id")

    def latest(self, spark: SparkSession) -> DataFrame:
        """The newest row of every (window, key): the log as an upserted table."""
        log = self.emitted(spark)
        by = ["window_start_ms", *self.keys]
        rest = [c for c in log.columns if c not in by]
        newest = log.groupBy(*by).agg(F.max_by(F.struct(*rest), "update").alias("_v"))
        return newest.select(*by, *[F.col("_v")[c].alias(c) for c in rest])

    def late(self, spark: SparkSession) -> DataFrame:
        """Late rows in all columns, with ``late_count``: how many there were
        up to and with the row."""
        return self._committed(spark, "late", self._row_schema().add("late_count", "long"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All annotated rows with ``is_late``."""
        return self._committed(spark, "rows", self._row_schema().add("is_late", "boolean"))


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """A Parquet folder, or None where it does not exist or holds no file."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(schema).parquet(path)
        return found if found.inputFiles() else None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
