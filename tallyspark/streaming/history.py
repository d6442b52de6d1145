"""Past-only history on a stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUTPUT = "conversation_index long, turn_index long, text string, history string"
COLUMNS = ["conversation_index", "turn_index", "text", "history"]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnHistory(StatefulProcessor):
    """Holds turns until the watermark has passed them, then emits them in turn order.

    Whatever arrives behind the watermark has been dropped (and counted) by Spark, so an emitted history can never miss a turn that
    comes in later. ``past`` only ever grows by the turns just emitted, ``waiting`` is rewritten with what is left of the
    delay. Each waiting turn has a timer at its own time; a last one, ``idle_ms`` after the newest turn, removes all state.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "turn_index long, at_ms long, author string, text string")
        self.past = handle.getListState("past", "author string, text string")
        self.newest = handle.getValueState("newest", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for frame in rows:
            turns = [(int(t), int(ms), author, text) for t, ms, author, text in zip(frame.turn_index, frame.at_ms, frame.author, frame.text)]
            self.waiting.appendList(turns)
            for at in {ms for _, ms, _, _ in turns}:
                self.handle.registerTimer(at)
                newest = at if newest is None else max(newest, at)
        if newest is not None:
            self.newest.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = 0
        while ready < len(waiting) and waiting[ready][1] <= watermark:
            ready += 1
        out, emitted = [], []
        if ready:
            lines = [f"[{author}] {text}" for author, text in self.past.get()] if self.past.exists() else []
            for turn, _, author, text in waiting[:ready]:
                if author == "customer":
                    out.append((key[0], turn, text, "\n".join(lines)))
                lines.append(f"[{author}] {text}")
                emitted.append((author, text))
            self.past.appendList(emitted)
            waiting = waiting[ready:]
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
        if not waiting and self.newest.exists() and self.newest.get()[0] + self.idle_ms <= watermark:
            self.past.clear()
            self.newest.clear()
        yield pd.DataFrame(out, columns=COLUMNS)


def use_rocksdb(spark: SparkSession) -> None:
    """State of named variables and timers lives in the RocksDB store; streams with a checkpoint keep the store they began with."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def history_stream(turns: DataFrame, delay: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Customer turns with all earlier turns of their conversation.

    Needs conversation_index, turn_index, author, text and the event time ``at``. ``delay`` is how far turns may arrive out of
    order. State is kept per conversation until the watermark is ``idle`` past its newest turn; a turn that comes even
    later begins a new history.
    """
    use_rocksdb(turns.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = turns.withWatermark("at", delay).select(
        "conversation_index", "turn_index", "author", "text", "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("conversation_index").transformWithStateInPandas(TurnHistory(idle_ms), OUTPUT, "append", "eventTime")
