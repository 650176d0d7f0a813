"""Command-line jobs: replay a trip file under a watermark bound.

    python -m tardy.plans.jobs tumbling|sliding <trips.parquet> <out_dir> [bound_minutes]

The bound is in minutes, default 30; an unparsable value falls back to 30.
Writes the result lines (``(start,taxi,sum,delay)``) as text under
``out_dir/results`` and prints the final late-row count.  The order of replay
is the Parquet file order: files by path, then row position within a file.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

DEFAULT_BOUND_MIN = 30


def parse_bound_minutes(args: list[str]) -> int:
    if not args:
        return DEFAULT_BOUND_MIN
    try:
        return int(args[0])
    except ValueError:
        print(f"invalid bound {args[0]!r}, using {DEFAULT_BOUND_MIN} minutes")
        return DEFAULT_BOUND_MIN


def replay_files(spark, path: str, spec, bound_ms: int, truncate_values: bool = True, columns: dict | None = None):
    """(result rows, late rows) of the tips job over Parquet files in file
    order.  The annotated rows are written once and serve both."""
    from tardy.operators.late import split_late
    from tardy.plans.replay import annotate, windowed_result
    from tardy.session import materialize
    from tardy.sources.trips import read_trips, with_file_order

    named = {"columns": columns} if columns else {}
    trips = with_file_order(read_trips(spark, path, truncate_values=truncate_values, **named)).drop("src_file")
    ann = materialize(annotate(trips, bound_ms, order_by=["arrival_key"]))
    res = windowed_result(ann, bound_ms, spec, ["taxi_id"], [F.sum("tip").alias("sum_tip")])
    _, late = split_late(ann, "start_ms", spec.size_ms, spec.slide_ms, allowed_lateness_ms=spec.allowed_lateness_ms)
    return res, late


def run(spark, kind: str, path: str, out_dir: str, bound_min: int, truncate_values: bool = True, columns: dict | None = None) -> int:
    from tardy.plans.replay import HOUR_MS, MINUTE_MS, WindowSpec
    from tardy.sinks.text import write_results

    spec = WindowSpec(HOUR_MS, 30 * MINUTE_MS if kind == "sliding" else None)
    res, late = replay_files(spark, path, spec, int(bound_min) * MINUTE_MS, truncate_values, columns)
    write_results(res, f"{out_dir}/results")
    n = late.count()
    print(f"late rows: {n}")
    return n


def main(argv: list[str]) -> None:
    from tardy.session import get_session
    if len(argv) < 3:
        print(__doc__)
        raise SystemExit(2)
    kind, path, out_dir = argv[0], argv[1], argv[2]
    run(get_session(), kind, path, out_dir, parse_bound_minutes(argv[3:]))


if __name__ == "__main__":
    main(sys.argv[1:])
