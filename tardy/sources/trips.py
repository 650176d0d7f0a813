"""Trip sources: Parquet with a column mapping, headered CSV text, test tables.

Declared trip schema (``tardy.schema.TRIP``): ``ride_id, taxi_id, start_ms,
tip, total_fare`` plus the arrival-order columns the caller picks.

Null policy for the columns a replay uses (start, taxi, tip): the replayed
job failed on a null number; here ``split_rejects`` keeps such rows out and
returns them as a counted reject table, and ``fail_on_null`` reproduces the
failure.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.functions.columns import parse_money, parse_time_text, to_epoch_ms, truncate_whole

# Column names of the public NYC yellow-taxi trip files.
NYC_COLUMNS = {
    "start": "tpep_pickup_datetime",
    "end": "tpep_dropoff_datetime",
    "taxi": "VendorID",
    "tip": "tip_amount",
    "fare": "total_amount",
}

# The driver's ``events`` table standing in for trips.
EVENTS_COLUMNS = {"start": "ts", "taxi": "event_type", "tip": "value", "ride": "event_id"}


def trips_from(df: DataFrame, columns: dict, truncate_values: bool = False,
               order_cols: tuple = ()) -> DataFrame:
    """Map a table to the trip schema.

    ``start`` may be a timestamp (any zone kind, read as UTC) or epoch
    microseconds (long).  With ``truncate_values`` tip and fare are cut to
    whole numbers toward zero (parity with the replayed job).
    """
    start = F.col(columns["start"])
    st_type = dict(df.dtypes)[columns["start"]]
    start_ms = to_epoch_ms(start) if st_type.startswith("timestamp") else F.floor(start / 1000).cast("long")

    def money(key):
        if not columns.get(key):
            return F.lit(None).cast("double")
        c = F.col(columns[key]).cast("double")
        return truncate_whole(c).cast("double") if truncate_values else c

    ride = F.col(columns["ride"]).cast("string") if columns.get("ride") else F.lit(None).cast("string")
    return df.select(
        ride.alias("ride_id"),
        F.col(columns["taxi"]).cast("string").alias("taxi_id"),
        start_ms.alias("start_ms"),
        money("tip").alias("tip"),
        money("fare").alias("total_fare"),
        *[F.col(c) for c in order_cols],
    )


def read_trips(spark: SparkSession, path: str | list[str], columns: dict | None = None,
               truncate_values: bool = False) -> DataFrame:
    """Parquet trips (one path or several); file order kept as ``(src_file, src_row)``."""
    cols = columns or NYC_COLUMNS
    raw = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    raw = raw.select("*", F.col("_metadata.file_path").alias("src_file"),
                     F.col("_metadata.row_index").alias("src_row"))
    out = trips_from(raw, cols, truncate_values, order_cols=("src_file", "src_row"))
    if not cols.get("ride"):
        out = out.withColumn("ride_id", F.col("src_row").cast("string"))
    return out


def parse_trip_lines(lines: DataFrame, text: str = "value", min_fields: int = 6,
                     keep: tuple = ()) -> DataFrame:
    """Headerless trip text lines to trips, split on every comma.

    Quotes do not protect commas and ids keep their quotes (parity); lines
    with fewer than ``min_fields`` fields are dropped.  Start text is
    ``MM/dd/yyyy hh:mm:ss a`` read as UTC; money drops ``$`` and quotes, empty
    is 0, anything else unparsable fails the job (ANSI cast).
    """
    parts = F.split(F.col(text), ",", -1)
    return (lines.select(*[F.col(c) for c in keep], parts.alias("_f"))
            .where(F.size("_f") >= min_fields)
            .select(*[F.col(c) for c in keep],
                    F.col("_f")[0].alias("ride_id"),
                    F.col("_f")[1].alias("taxi_id"),
                    F.unix_millis(parse_time_text(F.col("_f")[2])).alias("start_ms"),
                    parse_money(F.col("_f")[4]).alias("tip"),
                    parse_money(F.col("_f")[5]).alias("total_fare")))


def read_trips_csv(spark: SparkSession, path: str, min_fields: int = 6) -> DataFrame:
    """Headered trip CSV; the header line of every file is skipped.

    Each line is read whole (no quote handling, as in the replayed job) and
    split by :func:`parse_trip_lines`.  CSV carries no row position: the caller
    must add its own arrival order column before replaying.
    """
    raw = (spark.read.option("header", "true").option("sep", "\u0001")
           .option("quote", "\u0000").option("escape", "\u0000")
           .schema("value string").csv(path))
    return parse_trip_lines(raw, "value", min_fields)


def stream_trips(spark: SparkSession, path: str, columns: dict | None = None, truncate_values: bool = False,
                 files_per_trigger: int = 1000) -> DataFrame:
    """Parquet trips as a stream, with the file order kept as in
    :func:`read_trips`; nothing is rewritten.  Files are taken oldest first;
    :func:`with_file_order` orders those of one batch by path."""
    cols = columns or NYC_COLUMNS
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:      # one file: a stream takes folders
        raw = reader.option("pathGlobFilter", name).parquet(folder or "/")
    else:
        raw = reader.parquet(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.row_index").alias("src_row"))
    out = trips_from(raw, cols, truncate_values, order_cols=("src_file", "src_row"))
    return out if cols.get("ride") else out.withColumn("ride_id", F.col("src_row").cast("string"))


#: rows of one file in the arrival key, and most files that key has room for
FILE_ROWS, MAX_FILES = 1 << 32, 1 << 20
#: file names that the lookup table broadcasts at most (a few MB)
LOOKUP_FILES = 20_000


def with_file_order(df: DataFrame, file_col: str = "src_file", row_col: str = "src_row",
                    out: str = "arrival_key") -> DataFrame:
    """One numeric arrival key for multi-file input: ``file_rank * 2**32 + row``.

    The ranks come from the list of input files, which the driver holds for the
    scan anyway (a micro-batch has no such list: there the distinct names of its
    rows are read, as many as files a trigger takes).  No row is shuffled to
    rank them: the names are a lookup table, broadcast up to ``LOOKUP_FILES``.
    More than 2**20 files or 2**32 rows in one fail the job.
    """
    # a local path is written file:/x or file:///x
    name = F.regexp_replace(file_col, "^file:/+", "file:/")
    names = sorted({re.sub("^file:/+", "file:/", f) for f in df.inputFiles()})
    if not names:
        names = sorted(r[0] for r in df.select(name).where(F.col(file_col).isNotNull()).distinct().collect())
    if len(names) > MAX_FILES:
        raise ValueError(f"{len(names)} files: the arrival key has room for {MAX_FILES}")
    ranked = df.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "_fname string, _frank long")
    if len(names) <= LOOKUP_FILES:
        ranked = F.broadcast(ranked)
    row = F.col(row_col).cast("long")
    known = F.col("_frank").isNotNull() & (row < F.lit(FILE_ROWS))
    key = F.when(known, F.col("_frank") * F.lit(FILE_ROWS) + row).otherwise(F.raise_error(F.lit("a file is not in the list, or has 2**32 rows")))
    return df.join(ranked, name == F.col("_fname"), "left").withColumn(out, key.cast("long")).drop("_frank", "_fname")


USED = ("start_ms", "taxi_id", "tip")


def _bad(cols=USED):
    bad = None
    for c in cols:
        e = F.col(c).isNull()
        bad = e if bad is None else bad | e
    return bad


def split_rejects(trips: DataFrame, cols=USED) -> tuple[DataFrame, DataFrame]:
    """(rows with every used column set, rejected rows)."""
    bad = _bad(cols)
    return trips.where(~bad), trips.where(bad)


def fail_on_null(trips: DataFrame, cols=USED) -> DataFrame:
    """Fail the job on the first row with a null used column (parity mode)."""
    # a predicate, not a projected column: pruning cannot drop the check
    return trips.where(F.when(_bad(cols), F.raise_error(F.lit("null in a trip column the replay uses")))
                       .otherwise(F.lit(True)))


def read_trips_csv_standard(spark: SparkSession, path: str, columns: dict | None = None) -> DataFrame:
    """Idiomatic CSV read: Spark's CSV parser (quotes protect commas), header,
    malformed lines dropped.  Column names as in the header."""
    cols = columns or {"ride": 0, "taxi": 1, "start": 2, "tip": 4, "fare": 5}
    raw = (spark.read.option("header", "true").option("mode", "DROPMALFORMED")
           .option("inferSchema", "false").csv(path))
    names = raw.columns
    return raw.select(F.col(names[cols["ride"]]).alias("ride_id"), F.col(names[cols["taxi"]]).alias("taxi_id"),
                      F.unix_millis(parse_time_text(F.col(names[cols["start"]]))).alias("start_ms"),
                      parse_money(F.col(names[cols["tip"]])).alias("tip"),
                      parse_money(F.col(names[cols["fare"]])).alias("total_fare"))
