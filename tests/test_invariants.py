"""Randomized checks against the plain-Python contract (tests/brute.py)."""

import random

import pytest
from pyspark.sql import functions as F

from brute import replay, watermark_series
from tardy.operators.late import split_late
from tardy.operators.watermark import annotate_watermark
from tardy.plans.replay import WindowSpec, windowed_result

SCHEMA = "seq long, start_ms long, taxi_id string, tip double"


def make_rows(seed, n=300, spread=50_000, keys="abc"):
    rnd = random.Random(seed)
    rows, t = [], 1_000_000
    for i in range(n):
        t += rnd.randint(0, 2_000)
        ev = t - rnd.randint(0, spread) if rnd.random() < 0.5 else t
        rows.append((i, ev if rnd.random() > 0.02 else None, rnd.choice(keys), float(rnd.randint(-3, 9))))
    return rows


def spark_replay(spark, rows, bound, size, slide=None, n_blocks=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    ann = annotate_watermark(df, "start_ms", ["seq"], bound, n_blocks=n_blocks, **kw)
    res = windowed_result(ann, bound, WindowSpec(size, slide), ["taxi_id"], [F.sum("tip").alias("sum_tip")])
    _, late = split_late(ann, "start_ms", size, slide)
    got = {(r.window_start_ms, r.taxi_id): (r.sum_tip, r.delay_ms) for r in res.collect()}
    return got, sorted(r.seq for r in late.collect())


@pytest.mark.parametrize("seed,bound,size,slide,emit,lanes,blocks", [
    (1, 0, 10_000, None, 1, 1, 1),
    (2, 5_000, 10_000, None, 1, 1, 3),
    (3, 20_000, 10_000, 4_000, 1, 1, 8),
    (4, 5_000, 10_000, 5_000, 10, 1, 5),
    (5, 5_000, 10_000, None, 1, 4, 8),
    (6, 3_000, 7_000, 3_000, 7, 3, 4),
])
def test_matches_brute_force(spark, seed, bound, size, slide, emit, lanes, blocks):
    rows = make_rows(seed)
    want, want_late = replay([(t, k, v) for _, t, k, v in rows], bound, size, slide, emit, lanes)
    got, late = spark_replay(spark, rows, bound, size, slide, n_blocks=blocks, emit_every=emit, lanes=lanes)
    assert late == want_late
    assert got == want


def test_block_counts_give_equal_prefix_max(spark):
    rows = make_rows(11, n=500)
    df = spark.createDataFrame(rows, SCHEMA)
    outs = []
    for b in (1, 3, 8, 40):
        a = annotate_watermark(df, "start_ms", ["seq"], 0, n_blocks=b)
        outs.append(sorted((r.seq, r.m_vis, r.max_seen_ms) for r in a.collect()))
    assert all(o == outs[0] for o in outs)
    vis, _ = watermark_series([r[1] for r in rows], 0)
    assert [o[1] for o in outs[0]] == vis


def test_hot_arrival_instant_is_split_over_blocks(spark):
    from tardy.operators.order import range_blocks
    # a third of the rows share one arrival time: ties are split by the id
    rows = [(5_000 if i % 3 == 0 else i, i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "arr long, id long, t long")
    b = range_blocks(df, ["arr", "id"], n_blocks=12)
    sizes = [r["count"] for r in b.df.groupBy("_blk").count().collect()]
    assert max(sizes) < 3 * 3000 / 12
    a = annotate_watermark(df, "t", ["arr", "id"], 0, n_blocks=12)
    got = sorted((r.seq, r.m_vis) for r in a.collect())
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    vis, _ = watermark_series([r[2] for r in order], 0)
    assert [g[1] for g in got] == vis


def test_invariants(spark):
    rows = make_rows(21, n=400)
    plain = [(t, k, v) for _, t, k, v in rows]
    counts = [len(replay(plain, b, 10_000)[1]) for b in (0, 5_000, 20_000, 60_000)]
    assert counts == sorted(counts, reverse=True)        # larger bound never adds late rows
    lanes = [len(replay(plain, 5_000, 10_000, lanes=p)[1]) for p in (1, 2, 4)]
    assert lanes == sorted(lanes, reverse=True)          # more lanes never add late rows
    got, late = spark_replay(spark, rows, 10_000_000, 10_000)
    assert late == []                                    # bound above all disorder: exact
    total = {}
    for _, t, k, v in rows:
        if t is not None:
            ws = t - t % 10_000
            total[(ws, k)] = total.get((ws, k), 0) + v
    assert {key: s for key, (s, _) in got.items()} == total
    for _, (s, d) in spark_replay(spark, rows, 5_000, 10_000)[0].items():
        assert d == -1 or d >= 5_000 - 1                 # no window fires before the bound


@pytest.mark.parametrize("slide", [None, 4_000])
def test_firing_equals_brute_force_over_any_gap(spark, slide):
    from tardy.operators.late import one_pass_result

    def run(rows, keys=("taxi_id",)):
        df = spark.createDataFrame(rows, SCHEMA)
        ann = annotate_watermark(df, "start_ms", ["seq"], 5_000, n_blocks=4)
        r = one_pass_result(ann, "start_ms", list(keys), [F.sum("tip").alias("sum_tip"), F.count(F.lit(1)).alias("n")], 10_000, slide,
                            bound_ms=5_000, value_cols=["tip"])
        return sorted(tuple(x) for x in r.select("window_start_ms", *keys, "sum_tip", "delay_ms").collect())

    def brute(rows):
        want, _ = replay([(t, k, v) for _, t, k, v in rows], 5_000, 10_000, slide)
        return sorted((ws, key, s, d) for (ws, key), (s, d) in want.items())

    rows = make_rows(31, n=300)
    assert run(rows) == brute(rows)
    # a jump of 5,000,000 s and one far in the future: no window in between is listed
    rows += [(300, 5 * 10**9, "a", 1.0), (301, 1_200_000, "b", 2.0), (302, 10**15, "a", 1.0)]
    assert run(rows) == brute(rows)
    # rows with a null key advance the watermark but are in no result
    nulls = [(s, t, None if s % 5 == 0 else k, v) for s, t, k, v in rows]
    assert run(nulls) == [r for r in brute([(s, t, k or "null", v) for s, t, k, v in nulls]) if r[1] != "null"]
    # without keys there is one row for each window, and it counts data rows only
    alone = brute([(s, t, "all", v) for s, t, _, v in rows])
    assert run(rows, ()) == [(ws, s, d) for ws, _, s, d in alone]


def test_scored_windows_equal_truth_and_replay(spark):
    from tardy.operators.accuracy import ground_truth, scored_summary, scored_windows
    from tardy.plans.sweep import with_bounds
    rows = [(s, t, None if s % 9 == 0 else k, v) for s, t, k, v in make_rows(41, n=300)] + [(300, 5 * 10**9, "a", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tip_raw", F.col("tip") + F.lit(0.25))
    ann = with_bounds(annotate_watermark(df, "start_ms", ["seq"], None, n_blocks=4), [0, 5_000, 20_000])
    truth = {(r["window_start_ms"], r["taxi_id"]): r["true_tip"] for r in ground_truth(df, "start_ms", ["taxi_id"], "tip_raw", 10_000, 4_000).collect()}
    for keys in (["taxi_id"], []):
        sc = scored_windows(ann, "start_ms", keys, 10_000, 4_000, bound_col="bound_ms", late_counts=True)
        got = sc.where("window_start_ms IS NOT NULL").collect()
        if not keys:
            assert len({(r["bound_ms"], r["window_start_ms"]) for r in got}) == len(got)
            continue
        for b in (0, 5_000, 20_000):
            want, late = replay([(t, k or "null", v) for _, t, k, v in rows], b, 10_000, 4_000)
            mine = [r for r in got if r["bound_ms"] == b]
            assert {(r["window_start_ms"], r["taxi_id"]): r["true_tip"] for r in mine} == truth
            assert {(r["window_start_ms"], r["taxi_id"]): (r["est_tip"], r["delay_ms"]) for r in mine if r["in_result"]} == {
                k: v for k, v in want.items() if k[1] != "null"}
            summary = scored_summary(sc, ["bound_ms"]).where(F.col("bound_ms") == b).first()
            assert summary["n_keys"] == len(truth)


def test_hopping_windows_with_gaps(spark):
    # size < slide: rows between windows belong to none and are never late
    rows = make_rows(51, n=200)
    want, want_late = replay([(t, k, v) for _, t, k, v in rows], 3_000, 4_000, 10_000)
    got, late = spark_replay(spark, rows, 3_000, 4_000, 10_000, n_blocks=3)
    assert got == want and late == want_late


def test_null_arrival_keys_sort_first(spark):
    rnd = random.Random(61)
    rows = [(None if rnd.random() < 0.1 else rnd.randint(0, 500), i, rnd.randint(0, 10_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "arr long, id long, t long")
    a = annotate_watermark(df, "t", ["arr", "id"], 0, n_blocks=6)
    got = sorted((r.seq, r.m_vis) for r in a.collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    vis, _ = watermark_series([r[2] for r in order], 0)
    assert [g[1] for g in got] == vis


def test_order_columns_must_be_integral(spark):
    from tardy.operators.order import range_blocks
    df = spark.createDataFrame([(1.5, 1), (2.5, 2)], "arr double, id long")
    with pytest.raises(ValueError):
        range_blocks(df, ["arr", "id"], n_blocks=2)
