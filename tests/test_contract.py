"""Hand-made rows of the replay contract (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from tardy.operators.late import split_late
from tardy.operators.watermark import annotate_watermark
from tardy.plans.replay import HOUR_MS, MINUTE_MS, WindowSpec, windowed_result

DAY0 = 1704067200000  # 2024-01-01 00:00 UTC


def hm(h, m):
    return DAY0 + h * HOUR_MS + m * MINUTE_MS


ROWS = [(0, hm(0, 5), "a", 1.0), (1, hm(0, 50), "a", 1.0), (2, hm(1, 15), "a", 1.0),
        (3, hm(0, 59), "b", 1.0), (4, hm(0, 20), "a", 1.0), (5, hm(2, 10), "a", 1.0),
        (6, hm(1, 1), "a", 1.0)]
SCHEMA = "seq long, start_ms long, taxi_id string, tip double"


def result(spark, rows, bound=10 * MINUTE_MS, spec=WindowSpec(HOUR_MS), n_blocks=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    ann = annotate_watermark(df, "start_ms", ["seq"], bound, n_blocks=n_blocks, **kw)
    res = windowed_result(ann, bound, spec, ["taxi_id"], [F.sum("tip").alias("sum_tip")])
    _, late = split_late(ann, "start_ms", spec.size_ms, spec.slide_ms,
                         allowed_lateness_ms=spec.allowed_lateness_ms)
    got = {(r.window_start_ms, r.taxi_id): (r.sum_tip, r.delay_ms, r.flushed) for r in res.collect()}
    return got, sorted(r.seq for r in late.collect())


@pytest.mark.parametrize("n_blocks", [1, 3, 8])
def test_tumbling_contract(spark, n_blocks):
    got, late = result(spark, ROWS, n_blocks=n_blocks)
    assert got == {(hm(0, 0), "a"): (2.0, 15 * MINUTE_MS, False),
                   (hm(1, 0), "a"): (1.0, 10 * MINUTE_MS, False),
                   (hm(2, 0), "a"): (1.0, -1, True)}
    assert late == [3, 4, 6]


def test_sliding_row_open_in_one_window_only(spark):
    got, late = result(spark, ROWS, spec=WindowSpec(HOUR_MS, 30 * MINUTE_MS))
    assert late == [4, 6]                     # row 3 still counts in 00:30-01:30
    assert got[(hm(0, 30), "b")][0] == 1.0
    assert (hm(0, 0), "b") not in got


def test_row_exactly_at_end_minus_one_is_late(spark):
    # watermark after row 1 is exactly 00:59:59.999 = end - 1 of window 00:00
    rows = [(0, hm(0, 0), "a", 1.0), (1, hm(1, 0) - 1 + 10 * MINUTE_MS, "a", 1.0), (2, hm(0, 30), "a", 1.0)]
    got, late = result(spark, rows)
    assert late == [2]
    assert got[(hm(0, 0), "a")] == (1.0, 10 * MINUTE_MS - 1, False)


def test_ties_in_arrival_break_by_second_key(spark):
    df = spark.createDataFrame([(5, 1, 300), (5, 0, 100), (5, 2, 200)], "arr long, id long, t long")
    ann = annotate_watermark(df, "t", ["arr", "id"], 0, n_blocks=2).orderBy("id").collect()
    assert [(r.seq, r.m_vis) for r in ann] == [(0, None), (1, 100), (2, 300)]


def test_null_time_and_null_key(spark):
    rows = [(0, hm(0, 5), "a", 1.0), (1, None, "a", 5.0), (2, hm(0, 10), None, 7.0), (3, hm(0, 20), "a", 2.0)]
    got, late = result(spark, rows)
    assert got == {(hm(0, 0), "a"): (3.0, -1, True)}
    assert late == []


def test_empty_and_single_row(spark):
    got, late = result(spark, [])
    assert got == {} and late == []
    got, late = result(spark, [(0, hm(0, 5), "a", 2.5)])
    assert got == {(hm(0, 0), "a"): (2.5, -1, True)} and late == []


def test_truncation_and_money_parse(spark):
    from tardy.functions.columns import parse_money, truncate_whole
    nums = spark.createDataFrame([(2.99,), (-2.99,), (None,)], "x double")
    assert [r.w for r in nums.select(truncate_whole("x").alias("w")).collect()] == [2, -2, None]
    df = spark.createDataFrame([("2.99",), ("-2.99",), ("",), ('"$7.50"',), (" $3 ",)], "s string")
    assert [r.m for r in df.select(parse_money("s").alias("m")).collect()] == [2.99, -2.99, 0.0, 7.5, 3.0]
    with pytest.raises(Exception):
        spark.createDataFrame([("abc",)], "s string").select(parse_money("s")).collect()


def test_allowed_lateness_keeps_row_open(spark):
    rows = [(0, hm(0, 5), "a", 1.0), (1, hm(1, 15), "a", 1.0), (2, hm(0, 30), "a", 1.0)]
    _, late = result(spark, rows, spec=WindowSpec(HOUR_MS))
    assert late == [2]
    got, late = result(spark, rows, spec=WindowSpec(HOUR_MS, None, allowed_lateness_ms=10 * MINUTE_MS))
    assert late == [] and got[(hm(0, 0), "a")][0] == 2.0


def test_event_time_must_be_epoch_ms(spark):
    df = spark.createDataFrame([(0, 1.5)], "seq long, start_ms double")
    with pytest.raises(ValueError):
        annotate_watermark(df, "start_ms", ["seq"], 0)
