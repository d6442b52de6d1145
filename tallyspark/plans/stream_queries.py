"""Streams fed from the driver's tables; after availableNow they equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import chat_turns, table
from ..streaming.history import history_stream
from ..streaming.monitoring import monitoring
from ..streaming.runner import append_available, read_files
from ..streaming.sessions import sessions
from ..streaming.triage import gate_stream
from .listing_queries import _scored
from .registry import query
from .triage_queries import GATE, LABEL, TEXT_RULES, TURNS


SLICES = 3


def _through_files(spark, df, name, transform):
    """Lands a frame in time slices, runs the stream after each, and returns what the sink holds.

    The first column is the order of arrival. Every run continues from the checkpoint.
    """
    landing, sink, state = (scratch_path(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    place = F.col(df.columns[0]).cast("double")
    low, high = df.agg(F.min(place), F.max(place)).first()
    slice_no = F.least(F.lit(SLICES - 1), F.floor((place - low) / (high - low + 1) * SLICES))
    for n in range(SLICES):
        df.where(slice_no == n).write.mode("append").parquet(landing)
        stream = transform(read_files(spark, landing, df.schema))
        append_available(stream, sink, state)
    return spark.read.schema(stream.schema).parquet(sink)


@query("stream_rule_gate", f"""
WITH {TURNS}, {GATE} SELECT message_id, intent, urgent AS is_urgent, {LABEL} AS triage_label FROM decided WHERE rule_id IS NOT NULL""")
def stream_rule_gate(spark, folder):
    out = _through_files(spark, chat_turns(spark, folder), "gate", lambda s: gate_stream(s, TEXT_RULES))
    return out.select("message_id", "intent", "is_urgent", "triage_label")


# The newest session or window is still open when the stream stops, so the checks close
# the data with a far later event and leave that one out.

@query("stream_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM s GROUP BY user_id, n""")
def stream_sessions(spark, folder):
    e = table(spark, folder, "events").select("ts", "user_id")
    closing = e.agg(F.max("ts").alias("ts")).select(
        F.timestamp_micros(F.unix_micros("ts") + F.lit(30 * 86_400_000_000)).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    out = _through_files(spark, e.unionByName(closing), "sessions", lambda s: sessions(s, "user_id", "ts", 6 * 3600, "1 hour"))
    return out.where("user_id >= 0").select(
        "user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("last_event").alias("last_us"), "events")


@query("stream_monitoring", """
SELECT event_type AS segment, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS listings, count_if(value < 10)::BIGINT AS unknown,
       count_if(value < 20)::BIGINT AS low_confidence FROM events GROUP BY ALL""")
def stream_monitoring(spark, folder):
    scored = _scored(spark, folder).select("ts", "segment", "top1_similarity", "category")
    closing = scored.agg(F.max("ts").alias("ts")).select(
        F.timestamp_micros(F.unix_micros("ts") + F.lit(30 * 86_400_000_000)).alias("ts"), F.lit("closing").alias("segment"),
        F.lit(1.0).alias("top1_similarity"), F.lit("known").alias("category"))
    out = _through_files(spark, scored.unionByName(closing), "monitoring", lambda s: monitoring(s, "segment", 0.2, delay="1 hour"))
    return out.where("segment <> 'closing'").select(
        "segment", F.to_date("window_start").cast("string").alias("day"), "listings", "unknown", "low_confidence")


@query("stream_history", f"""
WITH {TURNS}
SELECT m.conv_id AS conversation_index, m.turn AS turn_index, m.text, coalesce(string_agg('[' || t.author || '] ' || t.text, chr(10) ORDER BY t.turn), '') AS history
FROM msgs m LEFT JOIN turns t ON t.conv_id = m.conv_id AND t.turn < m.turn GROUP BY m.conv_id, m.turn, m.text""")
def stream_history(spark, folder):
    """Turns arrive in order of a clock that runs a minute per turn; the last turn closes the stream."""
    turns = chat_turns(spark, folder)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conversation_index") * 60 + F.col("turn_index") * 60)
    timed = turns.select(at.alias("at"), "conversation_index", "turn_index", "author", "text")
    closing = timed.agg(F.max("at").alias("at")).select(
        F.timestamp_micros(F.unix_micros("at") + F.lit(86_400_000_000)).alias("at"), F.lit(-1).cast("long").alias("conversation_index"),
        F.lit(0).cast("long").alias("turn_index"), F.lit("brand").alias("author"), F.lit("").alias("text"))
    return _through_files(spark, timed.unionByName(closing), "history", lambda s: history_stream(s, "10 minutes")).where("conversation_index >= 0")
