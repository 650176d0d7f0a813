"""Text sources and sinks on our own fixture lines (FIXTURES.md 1.2, 1.5)."""

import os
import tempfile

from pyspark.sql import functions as F

from tardy.sinks.text import adjust_delay, discard, format_results, rewrite_results, write_results, write_split
from tardy.sources.results_text import last_per_key, parse_results, read_results
from tardy.sources.trips import read_trips_csv

RESULT_LINES = [
    "(1706742000000,2,31.0,3391000)",
    "(1706742000000, 2, 7.0, 3991000)",
    "(1706997600000,2,1617.0,-1)",
    "",
    "not a result",
    "(1,2,3)",
    "(1706742000000,1,5.0,60000)",
]


def test_parse_result_forms(spark):
    df = spark.createDataFrame([(x,) for x in RESULT_LINES], "value string")
    got = [tuple(r) for r in parse_results(df).collect()]
    assert got == [(1706742000000, "2", 31.0, 3391000), (1706742000000, "2", 7.0, 3991000),
                   (1706997600000, "2", 1617.0, -1), (1706742000000, "1", 5.0, 60000)]


def test_last_line_wins_and_file_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tardy-test-")
    path = os.path.join(d, "window_result.txt")
    with open(path, "w") as f:
        f.write("\n".join(RESULT_LINES) + "\n")
    parsed = read_results(spark, path)
    last = {(r.window_start_ms, r.taxi_id): (r.sum_tip, r.delay_ms)
            for r in last_per_key(parsed, ["window_start_ms", "taxi_id"], ["src_file", "line_no"]).collect()}
    assert last[(1706742000000, "2")] == (7.0, 3991000)
    # shift delays, write spaced lines to a new path, read back
    out = os.path.join(d, "shifted")
    rewrite_results(parsed, 60000, out)
    back = read_results(spark, out).collect()
    assert sorted(r.delay_ms for r in back) == [-1, 120000, 3451000, 4051000]


def test_format_results_skips_nulls(spark):
    df = spark.createDataFrame([(1000, "a", 3.0, 5), (2000, None, 1.0, 6)],
                               "window_start_ms long, taxi_id string, sum_tip double, delay_ms long")
    assert [r.line for r in format_results(df).collect()] == ["(1000,a,3.0,5)"]
    assert [r.line for r in format_results(df, spaced=True).collect()] == ["(1000, a, 3.0, 5)"]
    assert adjust_delay(spark.createDataFrame([(5,), (-1,)], "delay_ms long"), 10).collect()[1].delay_ms == -1


def test_trip_csv_with_header(spark):
    d = tempfile.mkdtemp(prefix="tardy-test-")
    path = os.path.join(d, "trips.csv")
    with open(path, "w") as f:
        f.write("ride,taxi,start,end,tip,fare\n")
        f.write('"r1","t1",11/01/2025 12:00:00 AM,11/01/2025 12:10:00 AM,"$2.50",$10.00\n')
        f.write('r2,t2,"11/01/2025 01:30:15 PM",,,7\n')
        f.write("r3,t3,11/01/2025 01:30:15 PM,x\n")
    got = [tuple(r) for r in read_trips_csv(spark, path).collect()]
    assert got == [('"r1"', '"t1"', 1761955200000, 2.5, 10.0),
                   ("r2", "t2", 1762003815000, 0.0, 7.0)]


def test_split_and_discard_sinks(spark):
    d = tempfile.mkdtemp(prefix="tardy-test-")
    df = spark.range(10).withColumn("is_late", F.col("id") % 3 == 0)
    write_split(df, "is_late", os.path.join(d, "on_time"), os.path.join(d, "late"))
    assert spark.read.parquet(os.path.join(d, "late")).count() == 4
    assert spark.read.parquet(os.path.join(d, "on_time")).count() == 6
    res = spark.createDataFrame([(1000, "a", 3.0, 5)], "window_start_ms long, taxi_id string, sum_tip double, delay_ms long")
    write_results(res, os.path.join(d, "res"))
    assert spark.read.text(os.path.join(d, "res")).collect()[0].value == "(1000,a,3.0,5)"
    discard(df)


def test_reject_table_fail_mode_and_standard_csv(spark):
    import pytest
    from tardy.schema import TRIP, conform, missing_columns
    from tardy.sources.trips import fail_on_null, read_trips_csv_standard, split_rejects
    rows = [("r1", "a", 1000, 1.0, 2.0), ("r2", None, 2000, 1.0, 2.0), ("r3", "b", None, 1.0, 2.0),
            ("r4", "b", 3000, None, 2.0)]
    t = spark.createDataFrame(rows, TRIP)
    good, bad = split_rejects(t)
    assert [r.ride_id for r in good.collect()] == ["r1"] and bad.count() == 3
    with pytest.raises(Exception):
        fail_on_null(t).collect()
    assert fail_on_null(good).count() == 1
    assert missing_columns(t, TRIP) == [] and conform(t, TRIP).schema == TRIP
    d = tempfile.mkdtemp(prefix="tardy-test-")
    path = os.path.join(d, "trips.csv")
    with open(path, "w") as f:
        f.write("ride,taxi,start,end,tip,fare\n")
        f.write('r1,"t,1",11/01/2025 12:00:00 AM,,"$2.50",10\n')
    got = [tuple(r) for r in read_trips_csv_standard(spark, path).collect()]
    assert got == [("r1", "t,1", 1761955200000, 2.5, 10.0)]
