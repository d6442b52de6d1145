"""Session activity with idle expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values: idle time to live in seconds ---
TTL_DEFAULT, TTL_MIN, TTL_MAX = 3600, 300, 86_400
# ----------------------------------------------------


def checked_ttl(seconds: int) -> int:
    if not TTL_MIN <= seconds <= TTL_MAX:
        raise ValueError(f"idle TTL must be between {TTL_MIN} and {TTL_MAX} seconds")
    return seconds


def sessions(events: DataFrame, key: str, time: str, ttl_seconds: int = TTL_DEFAULT, delay: str | None = None) -> DataFrame:
    """(key, start, last event, events) per session; a session ends after the idle time.

    With ``delay`` the frame is a stream and gets a watermark; without, the same plan runs
    in batch and is the reference for the stream.
    """
    gap = f"{checked_ttl(ttl_seconds)} seconds"
    timed = events.withWatermark(time, delay) if delay else events
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.max(time).alias("last_event")
    ).select(key, F.col("w.start").alias("started"), "last_event", "events")
