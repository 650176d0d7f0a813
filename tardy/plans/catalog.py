"""Registered queries: each has a Spark plan ``fn(spark, sf_dir)`` and, where
the semantics fit SQL, a DuckDB oracle over the same parquet tables.

Fixtures: ``events`` stands in for taxi trips (key ``event_type`` as the taxi
company, value ``value`` as the tip, arrival clock from
:mod:`tardy.sources.disorder`); ``orders`` is a second, naturally disordered
feed (1-day windows, key ``o_orderpriority``, arrival in ``o_orderkey`` order).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.operators import accuracy as acc
from tardy.operators.late import late_count, split_late
from tardy.operators.updates import Agg
from tardy.plans import oracle as O
from tardy.plans.replay import (DAY_MS, HOUR_MS, MINUTE_MS, EVENT_ORDER, WindowSpec, annotate,
                                event_trips, table, tips_result, windowed_result)
from tardy.plans.sweep import RECORDED_BOUNDS_MIN, sweep_bounds, tradeoff_table
from tardy.sources.disorder import with_arrival_disorder
from tardy.sources.trips import EVENTS_COLUMNS, trips_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

B60 = 60 * MINUTE_MS
TUMBLE = WindowSpec(HOUR_MS)
SLIDE = WindowSpec(HOUR_MS, 30 * MINUTE_MS)
EV = O.src_events()
EV_RAW = O.src_events(truncate=False)
EV_ARR = O.arrival_sql()


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _truth(spark, sf_dir, spec: WindowSpec) -> DataFrame:
    raw = event_trips(spark, sf_dir, truncate_values=False)
    return acc.ground_truth(raw, "start_ms", ["taxi_id"], "tip", spec.size_ms, spec.slide_ms)


# --- core replay -----------------------------------------------------------

@register("tumbling_sum", O.result_sql(EV, HOUR_MS, None, B60))
def q_tumbling_sum(spark, sf_dir):
    return tips_result(event_trips(spark, sf_dir), B60, TUMBLE)


@register("sliding_sum", O.result_sql(EV, HOUR_MS, 30 * MINUTE_MS, B60))
def q_sliding_sum(spark, sf_dir):
    return tips_result(event_trips(spark, sf_dir), B60, SLIDE)


@register("allowed_lateness_sum", O.result_sql(EV, HOUR_MS, 30 * MINUTE_MS, 10 * MINUTE_MS, lateness=15 * MINUTE_MS))
def q_allowed_lateness(spark, sf_dir):
    """Windows stay open for 15 minutes after they fire."""
    return tips_result(event_trips(spark, sf_dir), 10 * MINUTE_MS, WindowSpec(HOUR_MS, 30 * MINUTE_MS, 15 * MINUTE_MS))


EV_FILE = O.src_events().replace(EV_ARR, "row_number() OVER ()")


@register("tips_job_files", f"""SELECT *, CAST(0 AS BIGINT) AS late_rows FROM ({O.result_sql(EV_FILE, HOUR_MS, None, 5 * MINUTE_MS)}) q
UNION ALL SELECT -1, '', 0.0, -1, false, count(*) FROM ({O.late_rows_sql(EV_FILE, HOUR_MS, None, 5 * MINUTE_MS)}) l""")
def q_tips_job_files(spark, sf_dir):
    """The tips job from Parquet in file order: results and, in one row of
    window -1, the number of late rows, from one annotated table."""
    from tardy.plans.jobs import replay_files
    res, late = replay_files(spark, f"{sf_dir}/events.parquet", WindowSpec(HOUR_MS), 5 * MINUTE_MS, columns=EVENTS_COLUMNS)
    rows = res.select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed", F.lit(0).cast("long").alias("late_rows"))
    count = late_count(late).select(
        F.lit(-1).cast("long").alias("window_start_ms"), F.lit("").alias("taxi_id"), F.lit(0.0).alias("sum_tip"),
        F.lit(-1).cast("long").alias("delay_ms"), F.lit(False).alias("flushed"), "late_rows")
    return rows.unionByName(count)


@register("watermark_emit10", O.result_sql(EV, HOUR_MS, None, B60, n=10))
def q_emit10(spark, sf_dir):
    return tips_result(event_trips(spark, sf_dir), B60, TUMBLE, emit_every=10)


@register("watermark_lanes", O.result_sql(EV, HOUR_MS, None, B60, p=4))
def q_lanes(spark, sf_dir):
    return tips_result(event_trips(spark, sf_dir), B60, TUMBLE, lanes=4)


@register("tumbling_count", O.result_sql(EV, 10_000, None, 3_000, agg="count(*)", agg_alias="n",
                                         key_alias="id"))
def q_tumbling_count(spark, sf_dir):
    """Sensor-style job: 10 s windows, 3 s bound, count per id."""
    trips = event_trips(spark, sf_dir).withColumnRenamed("taxi_id", "id")
    ann = annotate(trips, 3_000)
    res = windowed_result(ann, 3_000, WindowSpec(10_000), ["id"], [F.count(F.lit(1)).alias("n")],
                          value_cols=[])
    return res.select("window_start_ms", "id", "n", "delay_ms", "flushed")


@register("orders_daily_sum", O.result_sql(O.src_orders(), DAY_MS, None, 30 * DAY_MS,
                                           key_alias="priority", agg_alias="sum_price"))
def q_orders_daily(spark, sf_dir):
    cols = {"start": "o_orderdate", "taxi": "o_orderpriority", "tip": "o_totalprice", "ride": "o_orderkey"}
    trips = trips_from(table(spark, sf_dir, "orders"), cols, truncate_values=True, order_cols=("o_orderkey",))
    res = tips_result(trips, 30 * DAY_MS, WindowSpec(DAY_MS), order_by=["o_orderkey"])
    return res.select("window_start_ms", F.col("taxi_id").alias("priority"),
                      F.col("sum_tip").alias("sum_price"), "delay_ms", "flushed")


@register("late_rows", O.late_rows_sql(EV, HOUR_MS, None, B60))
def q_late_rows(spark, sf_dir):
    ann = annotate(event_trips(spark, sf_dir), B60)
    _, late = split_late(ann, "start_ms", HOUR_MS)
    return late.select("event_id", "start_ms", "arrival_ms", "wm_ms")


@register("late_count", f"""SELECT count(*) AS late_rows FROM ({O.late_rows_sql(EV, HOUR_MS, None, B60)}) q""")
def q_late_count(spark, sf_dir):
    return late_count(q_late_rows(spark, sf_dir))


@register("window_delay", f"""SELECT DISTINCT window_start_ms, window_start_ms + {HOUR_MS} AS window_end_ms,
    delay_ms, flushed FROM ({O.result_sql(EV, HOUR_MS, None, 30 * MINUTE_MS)}) q""")
def q_window_delay(spark, sf_dir):
    res = tips_result(event_trips(spark, sf_dir), 30 * MINUTE_MS, TUMBLE)
    return (res.select("window_start_ms", (F.col("window_start_ms") + HOUR_MS).alias("window_end_ms"),
                       "delay_ms", "flushed").distinct())


@register("watermark_annotate", f"""WITH {O.annotated(EV)}
SELECT id AS event_id, seq, mx AS max_seen_ms, mvis AS m_vis, mvis - {B60} AS wm_ms FROM m""")
def q_watermark_annotate(spark, sf_dir):
    ann = annotate(event_trips(spark, sf_dir), B60)
    return ann.select("event_id", "seq", "max_seen_ms", "m_vis", "wm_ms")


@register("disorder_events", f"""WITH {O.annotated(EV)}
SELECT id AS event_id, t AS start_ms, arr AS arrival_ms, seq FROM m""")
def q_disorder(spark, sf_dir):
    from tardy.operators.order import dense_seq
    trips = event_trips(spark, sf_dir)
    return dense_seq(trips, EVENT_ORDER).select("event_id", "start_ms", "arrival_ms", "seq")


# --- exact answer and accuracy ----------------------------------------------

@register("truth_tumbling", O.truth_sql(EV_RAW, HOUR_MS))
def q_truth_tumbling(spark, sf_dir):
    return _truth(spark, sf_dir, TUMBLE)


@register("truth_sliding", O.truth_sql(EV_RAW, HOUR_MS, 30 * MINUTE_MS))
def q_truth_sliding(spark, sf_dir):
    return _truth(spark, sf_dir, SLIDE)


def _aligned_sql(size, slide, bound) -> str:
    return f"""SELECT coalesce(tr.window_start_ms, rs.window_start_ms) AS window_start_ms,
       coalesce(tr.taxi_id, rs.taxi_id) AS taxi_id,
       coalesce(tr.true_tip, 0.0) AS true_tip, coalesce(rs.sum_tip, 0.0) AS est_tip,
       tr.window_start_ms IS NOT NULL AS in_truth, rs.window_start_ms IS NOT NULL AS in_result
FROM ({O.truth_sql(EV_RAW, size, slide)}) tr
FULL OUTER JOIN ({O.result_sql(EV, size, slide, bound)}) rs
  ON tr.window_start_ms = rs.window_start_ms AND tr.taxi_id = rs.taxi_id"""


# fixed value: 1e-9, over which a truth counts as nonzero
METRICS_SQL = """count(*) AS n_keys,
  CAST(sum(CAST(true_tip AS DECIMAL(38,6))) AS DOUBLE) AS true_sum,
  CAST(sum(CAST(est_tip AS DECIMAL(38,6))) AS DOUBLE) AS est_sum,
  CASE WHEN CAST(sum(CAST(true_tip AS DECIMAL(38,6))) AS DOUBLE) <> 0 THEN
    abs(CAST(sum(CAST(true_tip AS DECIMAL(38,6))) AS DOUBLE) - CAST(sum(CAST(est_tip AS DECIMAL(38,6))) AS DOUBLE))
    / CAST(sum(CAST(true_tip AS DECIMAL(38,6))) AS DOUBLE) * 100 END AS global_error_pct,
  CAST(sum(abs(CAST(est_tip AS DECIMAL(38,6)) - CAST(true_tip AS DECIMAL(38,6)))) AS DOUBLE) / count(*) AS mae,
  CAST(sum(CASE WHEN true_tip > 1e-9 THEN CAST(abs((est_tip - true_tip) / true_tip) * 100 AS DECIMAL(38,6)) END) AS DOUBLE)
    / count(CASE WHEN true_tip > 1e-9 THEN 1 END) AS mape_pct,
  CASE WHEN sum((true_tip - mean_tip) ** 2) > 0
       THEN round(1.0 - sum((est_tip - true_tip) ** 2) / sum((true_tip - mean_tip) ** 2), 9) ELSE 0.0 END AS r2"""


METRIC_NAMES = ["n_keys", "true_sum", "est_sum", "global_error_pct", "mae", "mape_pct", "r2", "n_truth", "n_result", "correct", "missing", "extra"]


def _centred(sql: str) -> str:
    """An aligned table with the mean of all truths, which R^2 is taken around."""
    return f"SELECT *, avg(true_tip) OVER () AS mean_tip FROM ({sql}) c"


def _scored_trips(spark, sf_dir) -> DataFrame:
    """Replay input carrying both the truncated tip (estimate) and the raw one (truth)."""
    ev = table(spark, sf_dir, "events")
    from tardy.sources.disorder import with_arrival_disorder
    from tardy.sources.trips import EVENTS_COLUMNS
    trips = trips_from(ev, EVENTS_COLUMNS, truncate_values=True, order_cols=("event_id", "value"))
    trips = trips.withColumnRenamed("value", "tip_raw")
    return with_arrival_disorder(trips, "start_ms", "event_id")


def _aligned(spark, sf_dir, spec=TUMBLE, bound=B60) -> DataFrame:
    """Truth and estimate per (window, key) from one replay pass (no join)."""
    ann = annotate(_scored_trips(spark, sf_dir), bound)
    sc = acc.scored_windows(ann, "start_ms", ["taxi_id"], spec.size_ms, spec.slide_ms, bound_ms=bound)
    return sc.select("window_start_ms", "taxi_id", "true_tip", "est_tip", "in_truth", "in_result")


@register("align_results", _aligned_sql(HOUR_MS, None, B60))
def q_align(spark, sf_dir):
    return _aligned(spark, sf_dir)


@register("accuracy_metrics", f"SELECT {METRICS_SQL} FROM ({_centred(_aligned_sql(HOUR_MS, None, B60))}) q")
def q_accuracy_metrics(spark, sf_dir):
    return acc.accuracy_metrics(_aligned(spark, sf_dir))


@register("accuracy_verdicts", f"""SELECT count(*) AS total_keys,
  count(CASE WHEN in_truth THEN 1 END) AS n_truth, count(CASE WHEN in_result THEN 1 END) AS n_result,
  count(CASE WHEN in_truth AND in_result AND abs(CAST(est_tip AS DECIMAL(38,6)) - CAST(true_tip AS DECIMAL(38,6))) <= 0.01 THEN 1 END) AS correct,
  count(*) - count(CASE WHEN in_truth AND in_result AND abs(CAST(est_tip AS DECIMAL(38,6)) - CAST(true_tip AS DECIMAL(38,6))) <= 0.01 THEN 1 END) AS incorrect,
  count(CASE WHEN in_truth AND NOT in_result THEN 1 END) AS missing,
  count(CASE WHEN in_result AND NOT in_truth THEN 1 END) AS extra,
  count(CASE WHEN in_truth AND in_result AND abs(CAST(est_tip AS DECIMAL(38,6)) - CAST(true_tip AS DECIMAL(38,6))) <= 0.01 THEN 1 END) / count(*) * 100 AS accuracy_pct
FROM ({_aligned_sql(HOUR_MS, None, B60)}) q""")
def q_accuracy_verdicts(spark, sf_dir):
    return acc.accuracy_verdicts(_aligned(spark, sf_dir), tolerance=0.01)


@register("avg_delay", f"""SELECT coalesce(CAST(sum(CASE WHEN NOT flushed THEN delay_ms END) AS DOUBLE)
    / count(CASE WHEN NOT flushed THEN delay_ms END) / 60000.0, 0.0) AS avg_delay_min,
  count(CASE WHEN NOT flushed THEN delay_ms END) AS n_delay,
  coalesce(CAST(sum(delay_ms) AS DOUBLE) / count(delay_ms) / 60000.0, 0.0) AS avg_delay_min_all,
  count(delay_ms) AS n_all
FROM ({O.result_sql(EV, HOUR_MS, None, B60)}) q""")
def q_avg_delay(spark, sf_dir):
    res = tips_result(event_trips(spark, sf_dir), B60, TUMBLE)
    return res.agg(*acc.delay_columns(), *acc.delay_columns(include_flushed=True, suffix="_all"))


# --- sweep -------------------------------------------------------------------

SWEEP_BOUNDS_MS = [b * MINUTE_MS for b in RECORDED_BOUNDS_MIN]


def _sweep_sql(size, slide) -> str:
    parts = [f"SELECT CAST({b} AS BIGINT) AS bound_ms, * FROM ({O.result_sql(EV, size, slide, b)}) q{i}"
             for i, b in enumerate(SWEEP_BOUNDS_MS)]
    return "\nUNION ALL\n".join(parts)


@register("bound_sweep", _sweep_sql(HOUR_MS, None))
def q_bound_sweep(spark, sf_dir):
    ann = annotate(event_trips(spark, sf_dir), None)
    return sweep_bounds(ann, SWEEP_BOUNDS_MS, HOUR_MS)


@register("bound_sweep_sliding", _sweep_sql(HOUR_MS, 30 * MINUTE_MS))
def q_bound_sweep_sliding(spark, sf_dir):
    ann = annotate(event_trips(spark, sf_dir), None)
    return sweep_bounds(ann, SWEEP_BOUNDS_MS, HOUR_MS, 30 * MINUTE_MS)


def _tradeoff_sql(size, slide) -> str:
    parts = []
    for i, b in enumerate(SWEEP_BOUNDS_MS):
        parts.append(f"""SELECT CAST({b // MINUTE_MS} AS BIGINT) AS bound_min, mt.*,
  (SELECT coalesce(CAST(sum(CASE WHEN NOT flushed THEN delay_ms END) AS DOUBLE)
      / count(CASE WHEN NOT flushed THEN delay_ms END) / 60000.0, 0.0)
   FROM ({O.result_sql(EV, size, slide, b)}) r) AS avg_delay_min,
  (SELECT count(CASE WHEN NOT flushed THEN delay_ms END) FROM ({O.result_sql(EV, size, slide, b)}) r) AS n_delay,
  (SELECT count(*) FROM ({O.late_rows_sql(EV, size, slide, b)}) l) AS late_rows
FROM (SELECT {METRICS_SQL} FROM ({_centred(_aligned_sql(size, slide, b))}) a) mt""")
    return "\nUNION ALL\n".join(parts)


@register("tradeoff_table", _tradeoff_sql(HOUR_MS, None))
def q_tradeoff(spark, sf_dir):
    """All bounds, truth, estimate, delay and late rows from one replay pass."""
    return tradeoff_table(annotate(_scored_trips(spark, sf_dir), None), SWEEP_BOUNDS_MS, HOUR_MS)


# --- disorder profile ----------------------------------------------------------

# fixed values: the date range of the recorded profile
PROFILE_FROM = "2024-01-01 00:00:00"
PROFILE_TO = "2024-04-10 00:00:00"

PROFILE_SQL = f"""WITH a AS ({EV_RAW}),
f AS (SELECT * FROM a WHERE t BETWEEN epoch_us(TIMESTAMP '{PROFILE_FROM}') // 1000 AND epoch_us(TIMESTAMP '{PROFILE_TO}') // 1000),
x AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY arr, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms FROM f),
d AS (SELECT *, CASE WHEN (t // 3600000) % 24 = (ms // 3600000) % 24 THEN 0.0 ELSE (ms - t) / 60000.0 END AS delay_minutes FROM x),
l AS (SELECT * FROM d WHERE delay_minutes > 0.1),
q AS (SELECT quantile_cont(delay_minutes, 0.99) AS q99 FROM l),
p AS (SELECT id AS event_id, k AS taxi_id, t AS start_ms, ms AS max_seen_ms, delay_minutes,
             CAST((ms // 60000) % 60 AS INTEGER) AS max_seen_minute FROM l
      WHERE delay_minutes <= (SELECT q99 FROM q))"""


def _profile(spark, sf_dir) -> DataFrame:
    from tardy.operators.profile import lateness_profile
    # the date range is on the stored column, so it reaches the Parquet scan
    ev = table(spark, sf_dir, "events").where(F.col("ts").between(F.lit(PROFILE_FROM).cast("timestamp_ntz"), F.lit(PROFILE_TO).cast("timestamp_ntz")))
    trips = with_arrival_disorder(trips_from(ev, EVENTS_COLUMNS, truncate_values=False, order_cols=("event_id",)), "start_ms", "event_id")
    prof = lateness_profile(trips, "start_ms", EVENT_ORDER, ["taxi_id"], tie="event_id")
    return prof.select("event_id", "taxi_id", "start_ms", "max_seen_ms", "delay_minutes", "max_seen_minute")


@register("lateness_profile", PROFILE_SQL + "\nSELECT * FROM p")
def q_lateness_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@register("lateness_histogram", PROFILE_SQL + """,
mm AS (SELECT min(max_seen_minute) AS mn, max(max_seen_minute) AS mx FROM p),
h AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((max_seen_minute - mn) / w), 99) ELSE 0 END AS INTEGER) AS bin, mn, w
      FROM (SELECT max_seen_minute, (SELECT mn FROM mm) AS mn, ((SELECT mx FROM mm) - (SELECT mn FROM mm)) / 100.0 AS w
            FROM p) pw)
SELECT bin, count(*) AS n, min(mn) + bin * min(w) AS lo FROM h GROUP BY bin""")
def q_lateness_histogram(spark, sf_dir):
    from tardy.operators.profile import histogram
    return histogram(_profile(spark, sf_dir), "max_seen_minute", 100).select("bin", "n", "lo")


# --- processing time and generated load ----------------------------------------

@register("proctime_sliding_sum", f"""WITH a AS ({EV}),
x AS (SELECT id % 10000 AS key, arr AS pt, (arr - arr % 500) - unnest(range(5)) * 500 AS ws FROM a)
SELECT ws AS window_start_ms, key, CAST(count(*) AS BIGINT) AS total FROM x
WHERE ws <= pt AND pt < ws + 2500 GROUP BY ws, key""")
def q_proctime(spark, sf_dir):
    """2.5 s windows every 0.5 s on the arrival clock, (id % 10000, 1) summed per key."""
    from tardy.operators.windows import assign_windows
    trips = event_trips(spark, sf_dir)
    x = trips.select(F.pmod("event_id", F.lit(10_000)).alias("key"), F.col("arrival_ms").alias("pt"),
                     F.lit(1).cast("long").alias("one"))
    return (assign_windows(x, "pt", 2_500, 500).groupBy("window_start_ms", "key")
            .agg(F.sum("one").alias("total")))


@register("gen_keyed", """SELECT (event_id * 20 + j) % 10000 AS key, CAST(count(*) AS BIGINT) AS total
FROM (SELECT event_id, unnest(range(20)) AS j FROM events) g GROUP BY 1""")
def q_gen_keyed(spark, sf_dir):
    """Generated keyed load (20 ids per event row, 10,000 keys), reduced per key."""
    from tardy.sources.generate import keyed_from
    load = keyed_from(table(spark, sf_dir, "events"), "event_id", keys=10_000, fanout=20)
    return load.groupBy("key").agg(F.sum("one").alias("total"))


# --- projections, filters, top-k -----------------------------------------------

@register("head_trips", f"""SELECT id AS event_id, arr AS arrival_ms, t AS start_ms, k AS taxi_id, raw_v AS tip
FROM ({EV}) a ORDER BY arr, id LIMIT 100""")
def q_head(spark, sf_dir):
    from tardy.operators.filters import head
    trips = event_trips(spark, sf_dir, truncate_values=False)
    return head(trips, EVENT_ORDER, 100).select("event_id", "arrival_ms", "start_ms", "taxi_id", "tip")


RANGE_FROM = "2024-01-05 00:00:00"
RANGE_TO = "2024-01-10 12:00:00"


@register("filter_range", f"""SELECT event_id, {O.MS} AS start_ms, event_type AS taxi_id, value AS tip FROM events
WHERE ts BETWEEN TIMESTAMP '{RANGE_FROM}' AND TIMESTAMP '{RANGE_TO}'""")
def q_filter_range(spark, sf_dir):
    from tardy.operators.filters import filter_range
    ev = filter_range(table(spark, sf_dir, "events"), "ts", RANGE_FROM, RANGE_TO)
    return trips_from(ev, {"start": "ts", "taxi": "event_type", "tip": "value"}, order_cols=("event_id",)) \
        .select("event_id", "start_ms", "taxi_id", "tip")


@register("scan_trips", f"""SELECT CAST(event_id AS VARCHAR) AS ride_id, event_type AS taxi_id, {O.MS} AS start_ms,
  value AS tip, CAST(NULL AS DOUBLE) AS total_fare, event_id AS src_row FROM events""")
def q_scan_trips(spark, sf_dir):
    from tardy.sources.trips import EVENTS_COLUMNS, read_trips
    t = read_trips(spark, f"{sf_dir}/events.parquet", EVENTS_COLUMNS)
    return t.select("ride_id", "taxi_id", "start_ms", "tip", "total_fare", "src_row")


# --- text in and out -------------------------------------------------------------
# Trip text lines are built from ``orders`` (so the input grows with the data):
# quoted ids on every third row, quoted times on every fourth, an empty tip on
# every fifth, and only five fields on every seventh (dropped by the parser).

def _orders_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    money = F.concat((cents / 100).cast("long").cast("string"), F.lit("."),
                     F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    when_txt = F.date_format(F.col("o_orderdate"), "MM/dd/yyyy hh:mm:ss a")
    taxi = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))) \
        .otherwise(F.col("o_orderpriority"))
    start = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit('"'), when_txt, F.lit('"'))).otherwise(when_txt)
    tip = F.when(F.pmod(k, F.lit(5)) == 0, F.lit("")).otherwise(F.concat(F.lit('"$'), money, F.lit('"')))
    full = F.concat_ws(",", k.cast("string"), taxi, start, F.lit(""), tip, money)
    short = F.concat_ws(",", k.cast("string"), taxi, start, F.lit(""), tip)
    return o.select(F.when(F.pmod(k, F.lit(7)) == 0, short).otherwise(full).alias("value"))


ORDERS_LINES_SQL = """SELECT CASE WHEN o_orderkey % 7 = 0 THEN concat_ws(',', CAST(o_orderkey AS VARCHAR), tx, st, '', tp)
            ELSE concat_ws(',', CAST(o_orderkey AS VARCHAR), tx, st, '', tp, money) END AS value
FROM (SELECT *,
        CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || '"' ELSE o_orderpriority END AS tx,
        CASE WHEN o_orderkey % 4 = 0 THEN '"' || strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') || '"'
             ELSE strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') END AS st,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '"$' || money || '"' END AS tp
      FROM (SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS money
            FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) c) m) z"""


def _money_sql(c: str) -> str:
    return f"coalesce(CAST(nullif(trim(regexp_replace({c}, '[\"$]', '', 'g')), '') AS DOUBLE), 0.0)"


@register("scan_trips_csv", f"""WITH l AS ({ORDERS_LINES_SQL}), p AS (SELECT string_split(value, ',') AS f FROM l)
SELECT f[1] AS ride_id, f[2] AS taxi_id,
       epoch_us(strptime(replace(f[3], '"', ''), '%m/%d/%Y %I:%M:%S %p')) // 1000 AS start_ms,
       {_money_sql('f[5]')} AS tip, {_money_sql('f[6]')} AS total_fare
FROM p WHERE len(f) >= 6""")
def q_scan_trips_csv(spark, sf_dir):
    from tardy.sources.trips import parse_trip_lines
    return parse_trip_lines(_orders_lines(spark, sf_dir))


@register("parse_trip_text", f"""SELECT o_orderkey,
  epoch_us(strptime(replace(tt, '"', ''), '%m/%d/%Y %I:%M:%S %p')) // 1000 AS start_ms,
  {_money_sql('mt')} AS amount
FROM (SELECT o_orderkey, '"' || strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') || '"' AS tt,
        CASE o_orderkey % 4 WHEN 0 THEN ' $' || m || ' ' WHEN 1 THEN '"' || m || '"' WHEN 2 THEN '' ELSE '-' || m END AS mt
      FROM (SELECT o_orderkey, o_orderdate,
              CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' ||
              lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS m FROM orders) a) b""")
def q_parse_trip_text(spark, sf_dir):
    """Time and money text forms: quoted pattern time; ' $x ', '"x"', '' (= 0), '-x'."""
    from tardy.functions.columns import parse_money, parse_time_text
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    m = F.concat((cents / 100).cast("long").cast("string"), F.lit("."),
                 F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    tt = F.concat(F.lit('"'), F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a"), F.lit('"'))
    r = F.pmod(k, F.lit(4))
    mt = (F.when(r == 0, F.concat(F.lit(" $"), m, F.lit(" "))).when(r == 1, F.concat(F.lit('"'), m, F.lit('"')))
          .when(r == 2, F.lit("")).otherwise(F.concat(F.lit("-"), m)))
    return o.select("o_orderkey", F.unix_millis(parse_time_text(tt)).alias("start_ms"),
                    parse_money(mt).alias("amount"))


def _result_lines_sql(bound: int, spaced: bool) -> str:
    sep = ", " if spaced else ","
    return (f"SELECT '(' || window_start_ms || '{sep}' || taxi_id || '{sep}' || CAST(sum_tip AS VARCHAR) || '{sep}' "
            f"|| delay_ms || ')' AS line FROM ({O.result_sql(EV, HOUR_MS, None, bound)}) q")


@register("format_results", _result_lines_sql(B60, False))
def q_format_results(spark, sf_dir):
    from tardy.sinks.text import format_results
    return format_results(tips_result(event_trips(spark, sf_dir), B60, TUMBLE))


def _lines(spark, sf_dir) -> DataFrame:
    """Two runs' result lines (B = 0 spaced, then B = 60 compact) plus junk lines."""
    from tardy.sinks.text import format_results
    trips = event_trips(spark, sf_dir)
    r0 = format_results(tips_result(trips, 0, TUMBLE), spaced=True).select(F.col("line").alias("value"), F.lit(0).alias("run"))
    r60 = format_results(tips_result(trips, B60, TUMBLE)).select(F.col("line").alias("value"), F.lit(1).alias("run"))
    junk = table(spark, sf_dir, "region").select(
        F.explode(F.array(F.lit(""), F.col("r_name"), F.concat(F.lit("("), F.col("r_name"), F.lit(")")))).alias("value"),
        F.lit(2).alias("run"))
    return r0.unionByName(r60).unionByName(junk)


LINES_SQL = f"""SELECT line AS value, 0 AS run FROM ({_result_lines_sql(0, True)}) a
UNION ALL SELECT line AS value, 1 AS run FROM ({_result_lines_sql(B60, False)}) b
UNION ALL SELECT unnest(['', r_name, '(' || r_name || ')']) AS value, 2 AS run FROM region"""

PARSED_SQL = f"""SELECT run, CAST(trim(p[1]) AS BIGINT) AS window_start_ms, trim(p[2]) AS taxi_id,
  CAST(trim(p[3]) AS DOUBLE) AS sum_tip, CAST(trim(p[4]) AS BIGINT) AS delay_ms
FROM (SELECT run, trim(value) AS l, string_split(substr(trim(value), 2, length(trim(value)) - 2), ',') AS p
      FROM ({LINES_SQL}) x) y
WHERE starts_with(l, '(') AND ends_with(l, ')') AND len(p) = 4"""


@register("parse_results", f"SELECT window_start_ms, taxi_id, sum_tip, delay_ms FROM ({PARSED_SQL}) z")
def q_parse_results(spark, sf_dir):
    from tardy.sources.results_text import parse_results
    return parse_results(_lines(spark, sf_dir)).select("window_start_ms", "taxi_id", "sum_tip", "delay_ms")


@register("dedup_results", f"""SELECT window_start_ms, taxi_id, arg_max(sum_tip, run) AS sum_tip,
  arg_max(delay_ms, run) AS delay_ms FROM ({PARSED_SQL}) z GROUP BY window_start_ms, taxi_id""")
def q_dedup_results(spark, sf_dir):
    from tardy.sources.results_text import last_per_key, parse_results
    parsed = parse_results(_lines(spark, sf_dir), keep=("run",))
    return last_per_key(parsed, ["window_start_ms", "taxi_id"], ["run"])


EXTRA_SQL = "SELECT '(0, ' || r_name || ', 1.5, -1)' AS value, 3 AS run FROM region"
_VERDICT = "in_truth AND in_result AND abs(CAST(est_tip AS DECIMAL(38,6)) - CAST(true_tip AS DECIMAL(38,6))) <= 0.01"


@register("compare_results", f"""WITH parsed AS ({PARSED_SQL.replace(LINES_SQL, LINES_SQL + " UNION ALL " + EXTRA_SQL)}),
rs AS (SELECT window_start_ms, taxi_id, arg_max(sum_tip, run) AS sum_tip FROM parsed GROUP BY 1, 2),
q AS (SELECT coalesce(tr.true_tip, 0.0) AS true_tip, coalesce(rs.sum_tip, 0.0) AS est_tip,
        tr.window_start_ms IS NOT NULL AS in_truth, rs.window_start_ms IS NOT NULL AS in_result
      FROM ({O.truth_sql(EV_RAW, HOUR_MS, HOUR_MS)}) tr
      FULL OUTER JOIN rs ON tr.window_start_ms = rs.window_start_ms AND tr.taxi_id = rs.taxi_id)
SELECT {METRICS_SQL},
  count(CASE WHEN in_truth THEN 1 END) AS n_truth, count(CASE WHEN in_result THEN 1 END) AS n_result,
  count(CASE WHEN {_VERDICT} THEN 1 END) AS correct,
  count(CASE WHEN in_truth AND NOT in_result THEN 1 END) AS missing,
  count(CASE WHEN in_result AND NOT in_truth THEN 1 END) AS extra FROM ({_centred("SELECT * FROM q")}) z""")
def q_compare_results(spark, sf_dir):
    """Result lines against the exact answer: parsed, the last line of each key
    kept, outer-joined with the truth.  The lines hold a few keys that the
    truth lacks, and the truth holds keys that no line has."""
    from tardy.sources.results_text import last_per_key, parse_results
    extra = table(spark, sf_dir, "region").select(F.concat(F.lit("(0, "), "r_name", F.lit(", 1.5, -1)")).alias("value"), F.lit(3).alias("run"))
    parsed = parse_results(_lines(spark, sf_dir).unionByName(extra), keep=("run",))
    result = last_per_key(parsed, ["window_start_ms", "taxi_id"], ["run"])
    truth = acc.ground_truth(event_trips(spark, sf_dir, truncate_values=False), "start_ms", ["taxi_id"], "tip", HOUR_MS)
    return acc.align_results(truth, result, ["taxi_id"]).agg(*acc.metric_columns(0.01))


@register("adjust_delay", f"""SELECT window_start_ms, taxi_id,
  CASE WHEN delay_ms >= 0 THEN delay_ms + {5 * MINUTE_MS} ELSE delay_ms END AS delay_ms
FROM ({PARSED_SQL}) z WHERE run = 1""")
def q_adjust_delay(spark, sf_dir):
    from tardy.sinks.text import adjust_delay
    from tardy.sources.results_text import parse_results
    parsed = parse_results(_lines(spark, sf_dir), keep=("run",)).where(F.col("run") == 1)
    return adjust_delay(parsed, 5 * MINUTE_MS).select("window_start_ms", "taxi_id", "delay_ms")


# --- live (Structured Streaming) -------------------------------------------------

@register("live_tumbling_sum", O.result_sql(EV, HOUR_MS, None, B60))
def q_live_tumbling_sum(spark, sf_dir):
    """The tumbling job fed as micro-batches through ``foreachBatch``, one for
    each two million rows of the arrival order (four at least).

    The feed files and outputs live under the session's checkpoint folder; the
    answer must equal the batch replay (same oracle as ``tumbling_sum``).
    """
    from tardy.session import scratch_path
    from tardy.streaming.live import LiveReplay, write_arrival_files
    base = scratch_path(spark, "live")
    trips = event_trips(spark, sf_dir)
    write_arrival_files(trips, EVENT_ORDER, f"{base}/feed", max(4, -(-trips.count() // 2_000_000)))
    live = LiveReplay(f"{base}/out", "start_ms", EVENT_ORDER, B60, size_ms=HOUR_MS)
    stream = spark.readStream.schema(trips.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    q = live.start(stream, f"{base}/ckpt")
    q.awaitTermination()
    res = windowed_result(live.annotated(spark), B60, TUMBLE, ["taxi_id"], [F.sum("tip").alias("sum_tip")])
    return res.select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed")


# --- files written and read again --------------------------------------------------

JOB_SQL = O.result_sql(EV_FILE, HOUR_MS, None, 30 * MINUTE_MS)


@register("job_results_files", f"""WITH rs AS ({JOB_SQL}),
q AS (SELECT coalesce(tr.true_tip, 0.0) AS true_tip, coalesce(rs.sum_tip, 0.0) AS est_tip,
        tr.window_start_ms IS NOT NULL AS in_truth, rs.window_start_ms IS NOT NULL AS in_result
      FROM ({O.truth_sql(EV_RAW, HOUR_MS, HOUR_MS)}) tr
      FULL OUTER JOIN rs ON tr.window_start_ms = rs.window_start_ms AND tr.taxi_id = rs.taxi_id)
SELECT {METRICS_SQL}, count(CASE WHEN {_VERDICT} THEN 1 END) AS correct,
  (SELECT count(*) FROM rs) AS n_lines, (SELECT CAST(coalesce(sum(delay_ms), 0) AS BIGINT) FROM rs) AS delay_sum
FROM ({_centred("SELECT * FROM q")}) z""")
def q_job_results_files(spark, sf_dir):
    """The command-line job without a bound argument (30 minutes): its result
    folder of text lines is read again and compared with the exact answer."""
    from tardy.plans.jobs import parse_bound_minutes, run
    from tardy.session import scratch_path
    from tardy.sources.results_text import last_per_key, read_results
    out = scratch_path(spark, "job")
    run(spark, "tumbling", f"{sf_dir}/events.parquet", out, parse_bound_minutes([]), columns=EVENTS_COLUMNS)
    lines = read_results(spark, f"{out}/results")
    result = last_per_key(lines, ["window_start_ms", "taxi_id"], ["src_file", "line_no"])
    truth = acc.ground_truth(event_trips(spark, sf_dir, truncate_values=False), "start_ms", ["taxi_id"], "tip", HOUR_MS)
    measures = {c: m for c, m in zip(METRIC_NAMES, acc.metric_columns(0.01))}
    compared = acc.align_results(truth, result, ["taxi_id"]).agg(*[measures[c] for c in METRIC_NAMES[:7]], measures["correct"])
    counted = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("delay_ms"), F.lit(0)).cast("decimal(38,0)").alias("delay_sum"))
    both = compared.withColumn("_one", F.lit(1)).join(counted.withColumn("_one", F.lit(1)), "_one").drop("_one")      # one row each
    return both.withColumn("delay_sum", F.col("delay_sum").cast("long"))


@register("scan_trips_csv_files", ORACLES["scan_trips_csv"])
def q_scan_trips_csv_files(spark, sf_dir):
    """Headered CSV files of trip lines, written and read by the file source."""
    from tardy.session import scratch_path
    from tardy.sources.trips import read_trips_csv
    path = scratch_path(spark, "csv")
    (_orders_lines(spark, sf_dir).repartition(4).write.option("header", "true").option("sep", "\u0001").option("quote", "\u0000")
     .option("escape", "\u0000").option("quoteAll", "false").csv(path))
    return read_trips_csv(spark, path)


@register("record_forms", """SELECT event_id, epoch_us(ts) // 1000 AS ms, concat_ws(',', CAST(event_id AS VARCHAR), event_type, CAST(epoch_us(ts) AS VARCHAR)) AS record,
  strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS stamp,
  count(*) OVER (PARTITION BY event_type, user_id) AS n_same FROM events""")
def q_record_forms(spark, sf_dir):
    """Epoch microseconds as milliseconds and those as a timestamp, a record as
    text, and records told apart by hash: how many share an event's type and user."""
    from tardy.functions.columns import micros_to_ms, ms_to_timestamp, record_hash, record_text
    ev = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("h", record_hash("event_type", "user_id"))
    same = ev.groupBy("h").agg(F.count(F.lit(1)).alias("n_same"))
    return ev.join(same, "h").select("event_id", micros_to_ms("us").alias("ms"), record_text("event_id", "event_type", "us").alias("record"),
                                     F.date_format(ms_to_timestamp(micros_to_ms("us")), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"), "n_same")


# Live windows that every micro-batch closes (``streaming/emit.py``).  The feed is
# the trips in arrival order, two million rows a file and four files at least.

SUM_TIP = [Agg("sum_tip", "sum", "tip")]


def _play(spark, rows: DataFrame, order: list[str], ts: str, bound: int, spec: WindowSpec, keys: list[str], aggs: list[Agg], finish: bool = True):
    """Feed ``rows`` in ``order`` through the live engine to the end of input."""
    from tardy.session import scratch_path
    from tardy.streaming.emit import LiveWindows
    from tardy.streaming.live import write_arrival_files
    base = scratch_path(spark, "live")
    write_arrival_files(rows, order, f"{base}/feed", max(4, -(-rows.count() // 2_000_000)))
    live = LiveWindows(f"{base}/out", rows.schema, ts, order, bound, spec.size_ms, keys, aggs, spec.slide_ms, spec.allowed_lateness_ms)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    live.start(stream, f"{base}/ckpt").awaitTermination()
    live.finish(spark)
    return live


@register("live_window_emit", O.result_sql(EV, HOUR_MS, None, B60))
def q_live_window_emit(spark, sf_dir):
    """The tumbling job live: the rows that the batches emitted as windows closed."""
    live = _play(spark, event_trips(spark, sf_dir), EVENT_ORDER, "start_ms", B60, TUMBLE, ["taxi_id"], SUM_TIP)
    return live.emitted(spark).select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed")


@register("live_sliding_sum", O.result_sql(EV, HOUR_MS, 30 * MINUTE_MS, B60))
def q_live_sliding_sum(spark, sf_dir):
    """The sliding job live."""
    live = _play(spark, event_trips(spark, sf_dir), EVENT_ORDER, "start_ms", B60, SLIDE, ["taxi_id"], SUM_TIP)
    return live.emitted(spark).select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed")


@register("live_tumbling_count", O.result_sql(EV, 10_000, None, 3_000, agg="count(*)", agg_alias="n", key_alias="id"))
def q_live_tumbling_count(spark, sf_dir):
    """The sensor job live: 10 s windows, 3 s bound, rows counted per id."""
    rows = event_trips(spark, sf_dir).select("event_id", "arrival_ms", "start_ms", F.col("taxi_id").alias("id"))
    live = _play(spark, rows, EVENT_ORDER, "start_ms", 3_000, WindowSpec(10_000), ["id"], [Agg("n", "count")])
    return live.emitted(spark).select("window_start_ms", "id", "n", "delay_ms", "flushed")


@register("live_proctime_sum", ORACLES["proctime_sliding_sum"])
def q_live_proctime_sum(spark, sf_dir):
    """The throughput job live on the arrival clock: a clock never falls, so a
    bound of one millisecond closes a window when the clock reaches its end."""
    rows = event_trips(spark, sf_dir).select("event_id", F.pmod("event_id", F.lit(10_000)).alias("key"), F.col("arrival_ms").alias("pt"), F.lit(1).cast("long").alias("one"))
    live = _play(spark, rows, ["pt", "event_id"], "pt", 1, WindowSpec(2_500, 500), ["key"], [Agg("total", "sum", "one")])
    return live.emitted(spark).select("window_start_ms", "key", "total")


LATE60 = O.late_rows_sql(EV, HOUR_MS, None, B60)


@register("live_late_count", f"""WITH {O.annotated(EV)}, l AS (SELECT id, seq FROM m WHERE coalesce((t - t % {HOUR_MS}) + {HOUR_MS} - 1 <= mvis - {B60}, false))
SELECT id AS event_id, row_number() OVER (ORDER BY seq) AS late_count FROM l""")
def q_live_late_count(spark, sf_dir):
    """The running count of late rows (1, 2, 3, ...), live: one row for each."""
    live = _play(spark, event_trips(spark, sf_dir), EVENT_ORDER, "start_ms", B60, TUMBLE, ["taxi_id"], SUM_TIP)
    return live.late(spark).select("event_id", "late_count")


@register("live_split", f"""SELECT a.event_id, l.event_id IS NOT NULL AS is_late FROM events a LEFT JOIN ({LATE60}) l ON l.event_id = a.event_id""")
def q_live_split(spark, sf_dir):
    """Rows in windows and late rows as two outputs under one manifest."""
    live = _play(spark, event_trips(spark, sf_dir), EVENT_ORDER, "start_ms", B60, TUMBLE, ["taxi_id"], SUM_TIP)
    on_time = live.rows(spark).where("NOT is_late").select("event_id", F.lit(False).alias("is_late"))
    return on_time.unionByName(live.late(spark).select("event_id", F.lit(True).alias("is_late")))


LOG_SPEC = WindowSpec(HOUR_MS, 30 * MINUTE_MS, 15 * MINUTE_MS)
LOG_SQL = O.updates_sql(EV, HOUR_MS, 30 * MINUTE_MS, 10 * MINUTE_MS, 15 * MINUTE_MS)


@register("lateness_updates", LOG_SQL)
def q_lateness_updates(spark, sf_dir):
    """First firings and every later change while a window stays 15 minutes."""
    from tardy.operators.updates import lateness_updates
    ann = annotate(event_trips(spark, sf_dir), 10 * MINUTE_MS)
    return lateness_updates(ann, "start_ms", ["taxi_id"], SUM_TIP, HOUR_MS, 30 * MINUTE_MS, 10 * MINUTE_MS, 15 * MINUTE_MS)


@register("live_lateness_updates", LOG_SQL)
def q_live_lateness_updates(spark, sf_dir):
    """The same log, live."""
    live = _play(spark, event_trips(spark, sf_dir), EVENT_ORDER, "start_ms", 10 * MINUTE_MS, LOG_SPEC, ["taxi_id"], SUM_TIP)
    return live.emitted(spark).drop("batch_id")


@register("live_tips_files", ORACLES["tips_job_files"])
def q_live_tips_files(spark, sf_dir):
    """The tips job as a stream over the trip files themselves, in file order."""
    from tardy.session import scratch_path
    from tardy.sources.trips import stream_trips, with_file_order
    from tardy.streaming.emit import LiveWindows
    stream = stream_trips(spark, f"{sf_dir}/events.parquet", EVENTS_COLUMNS, truncate_values=True)
    base = scratch_path(spark, "live")
    live = LiveWindows(f"{base}/out", with_file_order(stream.sparkSession.createDataFrame([], stream.schema)).schema, "start_ms", ["arrival_key"], 5 * MINUTE_MS,
                       HOUR_MS, ["taxi_id"], SUM_TIP, prepare=with_file_order)
    live.start(stream, f"{base}/ckpt").awaitTermination()
    live.finish(spark)
    rows = live.emitted(spark).select("window_start_ms", "taxi_id", "sum_tip", "delay_ms", "flushed", F.lit(0).cast("long").alias("late_rows"))
    count = late_count(live.late(spark)).select(
        F.lit(-1).cast("long").alias("window_start_ms"), F.lit("").alias("taxi_id"), F.lit(0.0).alias("sum_tip"),
        F.lit(-1).cast("long").alias("delay_ms"), F.lit(False).alias("flushed"), "late_rows")
    return rows.unionByName(count)
