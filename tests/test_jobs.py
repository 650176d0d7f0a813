"""Command-line job on a small NYC-shaped Parquet fixture."""

import os
import tempfile

from tardy.plans.jobs import parse_bound_minutes, run

DAY0 = 1704067200000


def test_bound_argument():
    assert parse_bound_minutes([]) == 30
    assert parse_bound_minutes(["60"]) == 60
    assert parse_bound_minutes(["abc"]) == 30


def test_tumbling_job_on_parquet(spark):
    d = tempfile.mkdtemp(prefix="tardy-job-")
    mins = [5, 50, 75, 59, 20, 130, 61]
    rows = [(DAY0 + m * 60_000, DAY0 + m * 60_000 + 600_000, 2 if i != 3 else 1, 1.99, 10.0)
            for i, m in enumerate(mins)]
    df = spark.createDataFrame(rows, "p long, dr long, VendorID long, tip_amount double, total_amount double")
    df = df.selectExpr("timestamp_millis(p) AS tpep_pickup_datetime", "timestamp_millis(dr) AS tpep_dropoff_datetime",
                       "VendorID", "tip_amount", "total_amount")
    df.coalesce(1).write.parquet(os.path.join(d, "trips"))
    late = run(spark, "tumbling", os.path.join(d, "trips"), os.path.join(d, "out"), 10)
    assert late == 3
    lines = sorted(r.value for r in spark.read.text(os.path.join(d, "out", "results")).collect())
    assert lines == [f"({DAY0},2,2.0,900000)", f"({DAY0 + 3600000},2,1.0,600000)", f"({DAY0 + 7200000},2,1.0,-1)"]


def test_file_order_key(spark):
    from tardy.sources.trips import read_trips, with_file_order
    d = tempfile.mkdtemp(prefix="tardy-files-")
    for i in range(3):
        df = spark.createDataFrame([(DAY0 + (10 * i + j) * 60_000, 2, 1.0, 1.0) for j in range(4)],
                                   "p long, VendorID long, tip_amount double, total_amount double")
        df.selectExpr("timestamp_millis(p) AS tpep_pickup_datetime", "timestamp_millis(p) AS tpep_dropoff_datetime",
                      "VendorID", "tip_amount", "total_amount").coalesce(1).write.parquet(os.path.join(d, f"f{i}"))
    t = with_file_order(read_trips(spark, [os.path.join(d, f"f{i}") for i in range(3)]))
    got = [r.start_ms for r in t.orderBy("arrival_key").collect()]
    assert got == sorted(got) and len(got) == 12
