"""Difference-encoded sweeps, quantile by selection, block bounds with nulls
and ties, mergeable accuracy moments: against plain statements of each."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import replay
from tardy.operators import accuracy as acc
from tardy.operators.order import BLK, range_blocks
from tardy.operators.profile import exact_quantile
from tardy.operators.watermark import annotate_watermark
from tardy.plans.sweep import sweep_bounds, tradeoff_table


def trips(rng, n, top=120):
    out, clock = [], 0
    for i in range(n):
        clock += rng.randrange(0, 40)
        out.append((i, None if rng.random() < 0.05 else max(0, clock - rng.randrange(0, top)), None if rng.random() < 0.05 else rng.choice("aab"), float(rng.randrange(1, 9))))
    return out


@pytest.mark.parametrize("size,slide,bounds", [(100, None, [0, 30, 75]), (100, 40, list(range(0, 400, 2))), (50, 70, [20, 5, 20, 90]), (60, 20, [15])])
def test_sweep_equals_a_replay_for_each_bound(spark, size, slide, bounds):
    rng = random.Random(size + len(bounds))
    rows = trips(rng, 250)
    df = spark.createDataFrame([(*r, r[3] + 0.25) for r in rows], "pos long, start_ms long, taxi_id string, tip double, tip_raw double").repartition(3)
    ann = annotate_watermark(df, "start_ms", ["pos"], None, n_blocks=4)
    got = {}
    for r in sweep_bounds(ann, bounds, size, slide).collect():
        got.setdefault(r["bound_ms"], {})[r["window_start_ms"], r["taxi_id"]] = (r["sum_tip"], r["delay_ms"])
        assert r["flushed"] == (r["delay_ms"] == -1) or r["bound_ms"] == 0
    plain = [r[1:] for r in rows]
    want = {b: replay(plain, b, size, slide) for b in set(bounds)}
    assert got == {b: w for b, (w, _) in want.items()}
    truth, _ = replay([(t, k, None if v is None else v + 0.25) for t, k, v in plain], 10 ** 9, size, slide)
    table = {r["bound_min"]: r for r in tradeoff_table(ann.withColumn("start_ms", F.col("start_ms") * 60_000).withColumn("m_vis", F.col("m_vis") * 60_000)
                                                         .withColumn("m_after", F.col("m_after") * 60_000), [b * 60_000 for b in bounds], size * 60_000,
                                                         slide * 60_000 if slide else None).collect()}
    assert sorted(table) == sorted(set(bounds))
    for b in rng.sample(sorted(set(bounds)), min(8, len(set(bounds)))):
        w, late = want[b]
        r = table[b]
        # a minute scale keeps the order of all comparisons but the one-millisecond closing edge
        scaled, late = replay([(None if t is None else t * 60_000, k, v) for t, k, v in plain], b * 60_000, size * 60_000, slide * 60_000 if slide else None)
        delays = [d for _, d in scaled.values() if d != -1]
        assert (r["n_keys"], r["true_sum"], r["est_sum"], r["late_rows"], r["n_delay"]) == (
            len(truth), sum(s for s, _ in truth.values()), sum(s for s, _ in scaled.values()), len(late), len(delays))


def plain_r2(true, est):
    true, est = np.array(true, float), np.array(est, float)
    return 1 - ((est - true) ** 2).sum() / ((true - true.mean()) ** 2).sum()


def aligned(spark, rows):
    return spark.createDataFrame([(t, e, True, True) for t, e in rows], "true_tip double, est_tip double, in_truth boolean, in_result boolean").repartition(4)


def test_r2_of_large_values_close_together(spark):
    rows = [(1e9 + 0.01 * (i % 3), 1e9 + 0.01 * (i % 3) + 0.001) for i in range(10_000)]
    m = acc.accuracy_metrics(aligned(spark, rows)).first()
    assert abs(m["r2"] - 0.985) < 1e-4 and abs(m["r2"] - plain_r2(*zip(*rows))) < 1e-4 and abs(m["mae"] - 0.001) < 1e-9


def test_sums_past_a_million_million(spark):
    rows = [(2e12, 2e12 - 5), (7.25, 7.25), (3e15, 3e15), (0.0, 0.0), (1e-9, 4e6)]
    m = acc.accuracy_metrics(aligned(spark, rows)).first()
    assert m["true_sum"] == 3.002e15 + 7.25 and abs(m["mae"] - (5 + 4e6) / 5) < 1e-6 and abs(m["r2"] - plain_r2(*zip(*rows))) < 1e-9
    same = acc.accuracy_metrics(aligned(spark, [(5.5, 5.5)] * 9)).first()
    assert same["r2"] == 0.0 and same["mae"] == 0.0
    raw = spark.createDataFrame([(10, "a", 2e12), (20, "a", 0.000001), (20, "b", None)], "t long, k string, v double")
    got = {r["k"]: r["true_tip"] for r in acc.ground_truth(raw, "t", ["k"], "v", 100).collect()}
    assert got == {"a": 2e12 + 0.000001, "b": 0.0}
    fine = spark.createDataFrame([(1, "a", Decimal("0.000000001")), (2, "a", Decimal("123456789012345.000000002"))], "t long, k string, v decimal(30,9)")
    assert acc.sum_type(dict(fine.dtypes)["v"]) == "decimal(38,9)"
    assert acc.ground_truth(fine, "t", ["k"], "v", 100).first()["true_tip"] == float(Decimal("123456789012345.000000003"))


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_quantile_by_selection(spark, q):
    rng = random.Random(7)
    hot = [(60_000, 1.0)] * 300 + [(v, v / 60_000) for v in (rng.randrange(0, 10 ** 7) for _ in range(200))] + [(5, None)]
    for rows in (hot, hot[300:], [(7, 7 / 60_000)], [(1, 1 / 60_000), (2, 2 / 60_000)]):
        df = spark.createDataFrame(rows, "k long, v double").repartition(3)
        got = spark.range(1).select(exact_quantile(df, "k", "v", q, n_blocks=9).alias("x")).first()["x"]
        assert math.isclose(got, float(np.quantile([v for _, v in rows if v is not None], q)), rel_tol=1e-12)
    assert spark.range(1).select(exact_quantile(df.limit(0), "k", "v", q).alias("x")).first()["x"] is None


@pytest.mark.parametrize("kind", ["null", "hot", "both"])
def test_blocks_split_nulls_and_ties(spark, kind):
    rng = random.Random(3)

    def lead():
        r = rng.random()
        if kind != "hot" and r < 0.5:
            return None
        return 77 if kind != "null" and r < 0.75 else rng.randrange(-500, 500)
    rows = [(lead(), i) for i in rng.sample(range(-30_000, 30_000), 12_000)] + [(None, None)]
    df = spark.createDataFrame(rows, "p long, s long").repartition(6)
    b = range_blocks(df, ["p", "s"], n_blocks=12)
    got = b.df.collect()
    size = {}
    for r in got:
        size[r[BLK]] = size.get(r[BLK], 0) + 1
    assert len(got) == len(rows) and len(size) == 12 and max(size.values()) <= 2 * len(rows) / 12
    key = lambda r: (r["p"] is not None, r["p"] or 0, r["s"] is not None, r["s"] or 0)
    blocks = [r[BLK] for r in sorted(got, key=key)]
    assert blocks == sorted(blocks)                      # contiguous in the order, nulls first


def test_firing_across_blocks_of_ends(spark, monkeypatch):
    from tardy.operators import late
    from tardy.plans.replay import WindowSpec, windowed_result

    monkeypatch.setattr(late, "FIRING_BLOCK", 2)
    rows = trips(random.Random(11), 200, top=2000) + [(200, 10 ** 6, "a", 1.0), (201, 10 ** 6 - 5, "b", 2.0), (202, -3000, "a", 9.0)]
    df = spark.createDataFrame(rows, "pos long, start_ms long, taxi_id string, tip double")
    ann = annotate_watermark(df, "start_ms", ["pos"], 50, n_blocks=3)
    got = {(r["window_start_ms"], r["taxi_id"]): (r["sum_tip"], r["delay_ms"])
           for r in windowed_result(ann, 50, WindowSpec(100, 50), ["taxi_id"], [F.sum("tip").alias("sum_tip")]).collect()}
    assert got == replay([r[1:] for r in rows], 50, 100, 50)[0]


def test_file_order_without_a_join_on_rows(spark, tmp_path):
    from tardy.sources.trips import EVENTS_COLUMNS, read_trips, with_file_order

    folder = f"{tmp_path}/ev x%20"
    spark.range(40).selectExpr("id AS event_id", "timestamp_millis(id * 1000) AS ts", "'a' AS event_type", "1.5D AS value").repartition(4).write.parquet(folder)
    got = with_file_order(read_trips(spark, folder, EVENTS_COLUMNS)).collect()
    order = sorted(got, key=lambda r: (r["src_file"], r["src_row"]))
    assert [r["ride_id"] for r in sorted(got, key=lambda r: r["arrival_key"])] == [r["ride_id"] for r in order] and len({r["arrival_key"] for r in got}) == 40
    files = sorted({r["src_file"] for r in got})
    assert all(r["arrival_key"] == files.index(r["src_file"]) * 2 ** 32 + r["src_row"] for r in got)
