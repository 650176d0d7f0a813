"""Independent SQL oracles (DuckDB dialect) for the registered queries.

They state the contract the naive way: one global ``row_number`` for the
arrival order and ``max() OVER (ORDER BY seq ...)`` for the watermark, an
explicit enumeration of windows per row and a range join for firing.  Fine
as an oracle on small data; the Spark plans compute the same thing without
any global-order task.

Milliseconds come from ``epoch_us(ts) // 1000`` (floor, like Spark's
``unix_millis``; DuckDB's ``epoch_ms`` rounds).
"""

from __future__ import annotations

import math

from tardy.sources.disorder import DISORDER_MULTIPLIER, DISORDER_STEP_MS, DISORDER_STEPS

MS = "(epoch_us(ts) // 1000)"


def arrival_sql() -> str:
    return f"{MS} + ((event_id * {DISORDER_MULTIPLIER}) % {DISORDER_STEPS}) * {DISORDER_STEP_MS}"


def src_events(truncate: bool = True) -> str:
    v = "CAST(trunc(value) AS DOUBLE)" if truncate else "value"
    arr = arrival_sql()
    return (f"SELECT {MS} AS t, event_id AS id, event_type AS k, {v} AS v, {arr} AS arr, "
            f"value AS raw_v FROM events")


def src_orders(truncate: bool = True) -> str:
    v = "CAST(trunc(o_totalprice) AS DOUBLE)" if truncate else "o_totalprice"
    return ("SELECT (epoch_us(o_orderdate) // 1000) AS t, o_orderkey AS id, o_orderpriority AS k, "
            f"{v} AS v, o_orderkey AS arr, o_totalprice AS raw_v FROM orders")


def annotated(src: str, n: int = 1, p: int = 1) -> str:
    """CTEs ``a`` (source), ``s`` (seq), ``m`` (mvis, mafter, mx)."""
    head = (f"a AS ({src}),\n"
            "s AS (SELECT *, row_number() OVER (ORDER BY arr, id) - 1 AS seq FROM a),\n")
    if n == 1 and p == 1:
        return head + (
            "m AS (SELECT *, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mvis,\n"
            "  max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mafter,\n"
            "  max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx FROM s)")
    lanes = ",\n  ".join(
        f"max(CASE WHEN seq % {p} = {i} THEN t END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g{i}"
        for i in range(p))
    nulls = " OR ".join(f"g{i} IS NULL" for i in range(p))
    least = f"least({', '.join(f'g{i}' for i in range(p))})" if p > 1 else "g0"
    return head + (
        f"g AS (SELECT *, {lanes},\n"
        "  max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx FROM s),\n"
        f"e AS (SELECT *, CASE WHEN (seq + 1) % {n} = 0 THEN (CASE WHEN {nulls} THEN NULL ELSE {least} END) END AS em FROM g),\n"
        "m0 AS (SELECT *, max(em) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mvis FROM e),\n"
        "m AS (SELECT *, coalesce(em, mvis) AS mafter FROM m0)")


def pairs(size: int, slide: int, bound: int, lateness: int = 0) -> str:
    """CTEs ``x``, ``y``: (row, window) pairs with a ``closed`` flag; needs ``m``."""
    k = math.ceil(size / slide)
    return (f"x AS (SELECT m.*, (t - t % {slide}) - unnest(range({k})) * {slide} AS ws FROM m WHERE t IS NOT NULL),\n"
            f"y AS (SELECT *, ws + {size} AS we, coalesce(ws + {size} - 1 + {lateness} <= mvis - {bound}, false) AS closed "
            f"FROM x WHERE ws <= t AND t < ws + {size})")


def result_sql(src: str, size: int, slide: int | None, bound: int, n: int = 1, p: int = 1,
               agg: str = "sum(v)", agg_alias: str = "sum_tip", key_alias: str = "taxi_id", lateness: int = 0) -> str:
    slide = slide or size
    return f"""WITH {annotated(src, n, p)},
{pairs(size, slide, bound, lateness)},
r AS (SELECT ws, we, k, {agg} AS agg FROM y WHERE NOT closed AND k IS NOT NULL GROUP BY ws, we, k),
f AS (SELECT e.we, min(m.mafter) AS fire FROM (SELECT DISTINCT we FROM r) e JOIN m ON m.mafter - {bound} >= e.we - 1 GROUP BY e.we)
SELECT r.ws AS window_start_ms, r.k AS {key_alias}, r.agg AS {agg_alias},
       CAST(coalesce(f.fire - r.we, -1) AS BIGINT) AS delay_ms, f.fire IS NULL AS flushed
FROM r LEFT JOIN f ON f.we = r.we"""


def late_rows_sql(src: str, size: int, slide: int | None, bound: int, n: int = 1, p: int = 1) -> str:
    slide = slide or size
    return f"""WITH {annotated(src, n, p)}
SELECT id AS event_id, t AS start_ms, arr AS arrival_ms, mvis - {bound} AS wm_ms FROM m
WHERE t IS NOT NULL AND coalesce((t - t % {slide}) + {size} - 1 <= mvis - {bound}, false)"""


def truth_sql(src: str, size: int, slide: int | None = None, key_alias: str = "taxi_id",
              value_alias: str = "true_tip") -> str:
    slide = slide or size
    k = math.ceil(size / slide)
    return f"""WITH a AS ({src}),
x AS (SELECT k, raw_v, t, (t - t % {slide}) - unnest(range({k})) * {slide} AS ws FROM a WHERE t IS NOT NULL AND k IS NOT NULL)
SELECT ws AS window_start_ms, k AS {key_alias},
       CAST(coalesce(sum(CAST(raw_v AS DECIMAL(38,6))), 0) AS DOUBLE) AS {value_alias}
FROM x WHERE ws <= t AND t < ws + {size} GROUP BY ws, k"""


def updates_sql(src: str, size: int, slide: int | None, bound: int, lateness: int, key_alias: str = "taxi_id", value_alias: str = "sum_tip") -> str:
    """The log of windows: first firings, then every row within the allowed
    lateness with the running sum in arrival order."""
    slide = slide or size
    k = math.ceil(size / slide)
    return f"""WITH {annotated(src)},
x AS (SELECT m.*, (t - t % {slide}) - unnest(range({k})) * {slide} AS ws FROM m WHERE t IS NOT NULL AND k IS NOT NULL),
y AS (SELECT *, ws + {size} AS we, coalesce(ws + {size} - 1 <= mvis - {bound}, false) AS fired,
  coalesce(ws + {size} - 1 + {lateness} <= mvis - {bound}, false) AS gone FROM x WHERE ws <= t AND t < ws + {size}),
r AS (SELECT ws, we, k, sum(v) AS s FROM y WHERE NOT fired GROUP BY ws, we, k),
f AS (SELECT e.we, min(m.mafter) AS fire FROM (SELECT DISTINCT we FROM r) e JOIN m ON m.mafter - {bound} >= e.we - 1 GROUP BY e.we)
SELECT r.ws AS window_start_ms, r.k AS {key_alias}, CAST(0 AS BIGINT) AS update, r.s AS {value_alias},
  CAST(coalesce(f.fire - r.we, -1) AS BIGINT) AS delay_ms, f.fire IS NULL AS flushed
FROM r LEFT JOIN f ON f.we = r.we
UNION ALL
SELECT y.ws, y.k, CAST(row_number() OVER w - 1 + CASE WHEN r.ws IS NULL THEN 0 ELSE 1 END AS BIGINT),
  coalesce(r.s, 0) + sum(y.v) OVER w, CAST(y.mvis - y.we AS BIGINT), false
FROM y LEFT JOIN r ON r.ws = y.ws AND r.k = y.k WHERE y.fired AND NOT y.gone
WINDOW w AS (PARTITION BY y.ws, y.k ORDER BY y.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
