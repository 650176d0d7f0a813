"""tardy: event-time window and lateness analytics on Spark.

Replays a keyed, timestamped table in arrival order under a bounded-disorder
watermark, splits late rows from on-time ones, aggregates per event-time
window, reports how long each window waited before firing, and scores the
outcome against the exact batch answer.
"""

from tardy.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
