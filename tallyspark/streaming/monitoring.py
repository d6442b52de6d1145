"""Daily quality windows over scored listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.listing import UNKNOWN


def monitoring(scored: DataFrame, segment: str, low_confidence: float, window: str = "1 day", delay: str | None = None) -> DataFrame:
    """Counts per segment and tumbling window; rates are ratios of these counts.

    With ``delay`` the frame is a stream with a watermark, otherwise a batch.
    """
    timed = scored.withWatermark("ts", delay) if delay else scored
    return timed.groupBy(segment, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(F.col("category") == UNKNOWN).alias("unknown"),
        F.count_if(F.col("top1_similarity") < low_confidence).alias("low_confidence"),
    ).select(segment, F.col("w.start").alias("window_start"), "listings", "unknown", "low_confidence")
