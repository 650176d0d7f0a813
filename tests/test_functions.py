"""Scalar functions, generators and profile helpers."""

from pyspark.sql import functions as F

from tardy.functions.columns import (adjust_delay_col, floor_ms, micros_to_ms, minutes_between, modulo_key,
                                     ms_to_timestamp, record_hash, record_text, to_epoch_ms)
from tardy.operators.profile import exact_quantile, histogram, lateness, trim_tail
from tardy.sources.generate import gen_keyed, gen_rows


def test_generator_keeps_remainder_ids(spark):
    df = gen_rows(spark, 1003, lambda i: i.alias("id"), partitions=8)
    assert df.count() == 1003 and df.agg(F.max("id")).first()[0] == 1002
    k = gen_keyed(spark, 25, keys=10).groupBy("key").agg(F.sum("one").alias("n")).orderBy("key").collect()
    assert [r.n for r in k] == [3] * 5 + [2] * 5


def test_time_and_record_functions(spark):
    df = spark.createDataFrame([(1706742000123456, -1)], "us long, neg long")
    r = df.select(micros_to_ms("us").alias("ms"), floor_ms(F.col("neg"), 1000).alias("f"),
                  modulo_key(F.col("neg"), 7).alias("m")).first()
    assert (r.ms, r.f, r.m) == (1706742000123, -1000, 6)
    r = df.select(to_epoch_ms(ms_to_timestamp(F.lit(1706742000123))).alias("x"),
                  minutes_between(F.lit(180000), F.lit(60000)).alias("d"),
                  adjust_delay_col(F.lit(-1), 5).alias("a"), adjust_delay_col(F.lit(0), 5).alias("b")).first()
    assert (r.x, r.d, r.a, r.b) == (1706742000123, 2.0, -1, 5)
    t = spark.createDataFrame([("r1", "t1", 5)], "a string, b string, c long")
    r = t.select(record_text("a", "b", "c").alias("s"), record_hash("a", "b", "c").alias("h")).first()
    assert r.s == "r1,t1,5" and isinstance(r.h, int)


def test_lateness_forms(spark):
    day, hour = 86_400_000, 3_600_000
    df = spark.createDataFrame([(0, day), (hour, hour + 60_000)], "t long, mx long")
    parity = [r.delay_minutes for r in lateness(df, "t", "mx").collect()]
    sound = [r.delay_minutes for r in lateness(df, "t", "mx", same_window="date_hour").collect()]
    assert parity == [0.0, 0.0]          # a row exactly one day behind reads 0 by hour of day
    assert sound == [1440.0, 0.0]


def test_quantile_and_histogram(spark):
    import numpy as np
    vals = [float(v) for v in np.random.default_rng(3).integers(0, 10_000, 2001)]
    df = spark.createDataFrame([(int(v), i, v) for i, v in enumerate(vals)], "k long, id long, v double")
    q = df.select(exact_quantile(df, "k", "v", 0.99, "id")).first()[0]
    assert q == float(np.quantile(vals, 0.99))
    assert trim_tail(df, "k", "v", 0.99, "id").count() == sum(v <= q for v in vals)
    approx = trim_tail(df, "k", "v", 0.99, exact=False).count()
    assert abs(approx - sum(v <= q for v in vals)) <= 5
    h = {r.bin: r.n for r in histogram(df, "v", 100).collect()}
    counts, _ = np.histogram(vals, bins=100)
    assert [h.get(i, 0) for i in range(100)] == list(counts)


def test_trips_from_microsecond_longs_and_truncation(spark):
    from tardy.sources.trips import NYC_COLUMNS, trips_from
    df = spark.createDataFrame([(1706742000123999, 1706742600000000, 2, 2.99, -7.5)],
                               "tpep_pickup_datetime long, tpep_dropoff_datetime long, VendorID long, "
                               "tip_amount double, total_amount double")
    r = trips_from(df, NYC_COLUMNS, truncate_values=True).first()
    assert (r.taxi_id, r.start_ms, r.tip, r.total_fare) == ("2", 1706742000123, 2.0, -7.0)
    r = trips_from(df, NYC_COLUMNS).first()
    assert (r.tip, r.total_fare, r.ride_id) == (2.99, -7.5, None)
