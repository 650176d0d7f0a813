"""Live windows and the log of updates against a plain statement of both."""

import random

import pytest
from pyspark.sql import functions as F

from brute import replay, update_log
from tardy.operators.updates import Agg, lateness_updates, running
from tardy.operators.watermark import annotate_watermark
from tardy.streaming.emit import LiveWindows

AGGS = [Agg("total", "sum", "v"), Agg("n", "count"), Agg("low", "min", "v"), Agg("high", "max", "v")]
SCHEMA = "pos long, t long, k string, v long"


def trips(rng, n):
    out, clock = [], 0
    for i in range(n):
        clock += rng.randrange(0, 60)
        t = None if rng.random() < 0.06 else max(0, clock - rng.randrange(0, 150))
        out.append((i, t, None if rng.random() < 0.06 else rng.choice("aab"), rng.randrange(1, 9)))
    return out


def row_of(r, aggs=("total",)):
    return tuple(r[c] for c in ("window_start_ms", "k", "update", *aggs, "delay_ms", "flushed"))


@pytest.mark.parametrize("size,slide,bound,lateness", [(100, None, 40, 0), (100, 50, 20, 60), (90, 40, 0, 35), (50, 70, 30, 20), (100, None, 10, 1000)])
def test_update_log_against_brute_force(spark, size, slide, bound, lateness):
    rng = random.Random(size + lateness)
    rows = trips(rng, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ann = annotate_watermark(df, "t", ["pos"], bound, n_blocks=5)
    got = lateness_updates(ann, "t", ["k"], AGGS, size, slide, bound, lateness).collect()
    plain = [r[1:] for r in rows]
    log, _, _ = update_log(plain, bound, size, slide, lateness)
    assert sorted(map(row_of, got)) == sorted(log)
    newest = {}
    for r in got:
        if r["update"] >= newest.get((r["window_start_ms"], r["k"]), {"update": -1})["update"]:
            newest[r["window_start_ms"], r["k"]] = r
    for (ws, k), r in newest.items():                    # the last row is the window's final content
        assert r["low"] <= r["high"] and r["total"] >= r["n"]
    if not lateness:
        want, _ = replay(plain, bound, size, slide)
        assert {w: (r["total"], r["delay_ms"]) for w, r in newest.items()} == want


def play(spark, live, rows, step):
    for b, i in enumerate(range(0, len(rows), step)):
        live.process_batch(spark.createDataFrame(rows[i:i + step], SCHEMA), b)


def engine(spark, path, size=100, slide=50, bound=20, lateness=60, **more):
    return LiveWindows(str(path), spark.createDataFrame([], SCHEMA).schema, "t", ["pos"], bound, size, ["k"], AGGS, slide, lateness, n_blocks=2, **more)


@pytest.mark.parametrize("slide,lateness", [(50, 60), (None, 0)])
def test_small_batches_emit_each_window_once(spark, tmp_path, slide, lateness):
    rows = trips(random.Random(5), 40)
    plain = [r[1:] for r in rows]
    log, late, open_after = update_log(plain, 20, 100, slide, lateness)
    live = engine(spark, tmp_path, slide=slide, lateness=lateness)
    for b, i in enumerate(range(0, 40, 4)):
        live.process_batch(spark.createDataFrame(rows[i:i + 4], SCHEMA), b)
        # the state is what the rows so far leave open, no more
        state = live._open(spark, b).select("window_start_ms", "k").collect()
        assert sorted(map(tuple, state)) == open_after[i + 3]
    before = live.emitted(spark)
    assert sorted(map(row_of, before.collect())) == sorted(r for r in log if not r[5])
    live.finish(spark)
    live.finish(spark)                                   # a second end changes nothing
    assert sorted(map(row_of, live.emitted(spark).collect())) == sorted(log)
    told = live.late(spark).orderBy("late_count").collect()
    assert [r["pos"] for r in told] == late and [r["late_count"] for r in told] == list(range(1, len(late) + 1))
    assert sorted(r["pos"] for r in live.rows(spark).where("is_late").collect()) == late and live.rows(spark).count() == 40
    newest = {(r[0], r[1]): r for r in sorted(log, key=lambda r: r[2])}
    assert sorted(map(row_of, live.latest(spark).collect())) == sorted(newest.values())
    with pytest.raises(ValueError, match="closed"):
        live.process_batch(spark.createDataFrame(rows[:4], SCHEMA), 10)


def test_failure_between_outputs_is_not_seen(spark, tmp_path, monkeypatch):
    """Both outputs of a batch appear together, and a retry writes them again."""
    rows = trips(random.Random(7), 24)
    live = engine(spark, tmp_path)
    play(spark, live, rows[:16], 8)

    def seen():
        return (sorted(map(tuple, live.emitted(spark).collect()), key=str), sorted(map(tuple, live.late(spark).collect()), key=str),
                live.rows(spark).count(), live.commits(spark).count())
    old = seen()
    third = spark.createDataFrame(rows[16:], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(LiveWindows, "_windows", lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            live.process_batch(third, 2)                 # rows and late rows are written, windows are not
    assert seen() == old
    with monkeypatch.context() as m:
        m.setattr(LiveWindows, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            live.process_batch(third, 2)                 # all is written but the manifest
    assert seen() == old
    live.process_batch(third, 2)
    new = seen()
    assert new[2:] == (24, 3)
    live.process_batch(third, 2)                         # a batch that comes again is not written twice
    assert seen() == new
    log, late, _ = update_log([r[1:] for r in rows], 20, 100, 50, 60)
    assert sorted(map(row_of, live.emitted(spark).collect())) == sorted(r for r in log if not r[5])
    assert sorted(r["pos"] for r in live.late(spark).collect()) == late
    with pytest.raises(ValueError, match="committed"):
        live.process_batch(third, 4)


def test_empty_batches_and_nothing(spark, tmp_path):
    live = engine(spark, tmp_path)
    live.finish(spark)
    assert live.emitted(spark).count() == live.late(spark).count() == live.rows(spark).count() == 0
    rows = trips(random.Random(1), 12)
    live.process_batch(spark.createDataFrame([], SCHEMA), 0)
    live.process_batch(spark.createDataFrame(rows, SCHEMA), 1)
    live.process_batch(spark.createDataFrame([], SCHEMA), 2)
    live.finish(spark)
    log, _, _ = update_log([r[1:] for r in rows], 20, 100, 50, 60)
    assert sorted(map(row_of, live.emitted(spark).collect())) == sorted(log)


def test_lanes_and_cadence_live(spark, tmp_path):
    rows = [(i, 0 if t is None else t, k, v) for i, t, k, v in trips(random.Random(3), 36)]
    live = engine(spark, tmp_path, slide=None, lateness=0, emit_every=3, lanes=2)
    play(spark, live, rows, 9)
    live.finish(spark)
    want, _ = replay([r[1:] for r in rows], 20, 100, None, emit_every=3, lanes=2)
    assert {(r["window_start_ms"], r["k"]): (r["total"], r["delay_ms"]) for r in live.emitted(spark).collect()} == want


def test_running_values_across_blocks(spark, monkeypatch):
    """A group that holds most rows is spread over blocks of positions."""
    from tardy.operators import updates

    monkeypatch.setattr(updates, "RUN_BLOCK", 10)
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.8 else "cold", rng.choice([None, *range(9)])) for i in rng.sample(range(300), 200)]
    df = spark.createDataFrame(rows, "seq long, g string, v long")
    got = {r["seq"]: r for r in running(df, ["g"], [Agg("s", "sum", "v"), Agg("c", "count", "v"), Agg("m", "max", "v")]).collect()}
    for g in ("hot", "cold"):
        mine = sorted(r for r in rows if r[1] == g)
        for i, r in enumerate(mine):
            own = [x[2] for x in mine[:i + 1] if x[2] is not None]
            assert (got[r[0]]["s"], got[r[0]]["c"], got[r[0]]["m"], got[r[0]]["_n"]) == (sum(own) if own else None, len(own), max(own, default=None), i + 1)
    with pytest.raises(ValueError):
        Agg("x", "avg", "v")


@pytest.mark.parametrize("lateness", [0, 60])
def test_a_batch_makes_its_pairs_once(spark, tmp_path, lateness):
    """Windows are read from what the batch merged and wrote once: of the pairs
    only the updates within the allowed lateness are made again."""
    rows = trips(random.Random(9), 24)
    live = engine(spark, tmp_path, lateness=lateness)
    live.process_batch(spark.createDataFrame(rows, SCHEMA), 0)
    written = live._table(spark, "rows", live._row_schema().add("is_late", "boolean"), 0)
    plan = live._windows(spark, written, 0, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "merged" in {p.name for p in tmp_path.iterdir()} and ("Generate" in plan) == bool(lateness)
    log, _, _ = update_log([r[1:] for r in rows], 20, 100, 50, lateness)
    live.finish(spark)
    assert sorted(map(row_of, live.emitted(spark).collect())) == sorted(log)
