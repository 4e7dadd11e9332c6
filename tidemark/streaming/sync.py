"""Streams: events into the log with at-least-once sources, and sessions that end on a closing event or fall silent."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators import log, segments

logger = logging.getLogger(__name__)
FINAL_EVENTS = ["Stop", "SessionEnd"]
CAPTURE_SCHEMA = "session_id string, hook_event_name string, received_at timestamp, prompt string, tool_name string, tool_input string, tool_response string"
CAPTURE_FIELDS = [f.split()[0] for f in CAPTURE_SCHEMA.split(", ")]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(log.EVENT_SCHEMA).json(path)


def start_sync(events: DataFrame, log_path: str, checkpoint: str, interval: str | None = None):
    """Append a stream of events to the log: once over what is there, or at an interval.

    Each micro-batch is a commit of the segmented log with the ids that the log lacks, so a batch that runs again adds
    nothing; it opens only segments that may hold one of its ids. There is no watermark on valid time: late events are
    kept, and only the time of ingestion hides them from earlier reads.
    """

    def write(batch: DataFrame, _: int) -> None:
        segments.append(batch.sparkSession, batch, log_path)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def keep_syncing(start: Callable[[], StreamingQuery], attempts: int = 5, wait_seconds: float = 60) -> None:
    """Run a stream until it ends by itself; after a failure it is logged and started again from its checkpoint."""
    for attempt in range(1, attempts + 1):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException as failure:
            logger.error("sync failed, attempt %d of %d: %s", attempt, attempts, failure)
            if attempt == attempts:
                raise
            time.sleep(wait_seconds)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CAPTURE_SCHEMA).json(path)


class Sessions(StatefulProcessor):
    """The captures of each open session, kept by the stream's state until it closes or nothing has come for a while.

    A session is finished in the batch that brings its closing event, with all that came before, and its state is freed;
    so it is when its timer runs out. What comes later for the same session is a session of its own, and the richer
    capture wins downstream. Captures that come again are kept once.
    """

    def __init__(self, fields: list[str], idle_ms: int, final: list[str]):
        self.fields, self.idle_ms, self.final = fields, idle_ms, final
        self.at = fields.index("hook_event_name")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A map tells captures that were seen apart without reading the others.
        self.held = handle.getMapState("captures", "digest string", "body string")
        self.timer = handle.getValueState("timer", "due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed = False
        for row in rows:
            body = json.dumps([None if row[c] is None else row[c].isoformat() if isinstance(row[c], datetime) else row[c] for c in self.fields])
            self.held.updateValue((hashlib.sha256(body.encode()).hexdigest(),), (body,))
            closed = closed or row["hook_event_name"] in self.final
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if closed:
            yield from self._finish("closed")
        else:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._finish("idle")

    def _finish(self, why: str) -> Iterator[Row]:
        for (body,) in list(self.held.values()):
            values = dict(zip(self.fields, json.loads(body), strict=True))
            if values["received_at"] is not None:
                values["received_at"] = datetime.fromisoformat(values["received_at"])
            yield Row(**values, finished=why)
        self.held.clear()
        self.timer.clear()

    def close(self) -> None:
        pass


def sessions(captures: DataFrame, idle_seconds: float = 24 * 3600) -> DataFrame:
    """The captures of finished sessions, with ``finished``: ``closed`` by their closing event, or ``idle`` for that long.

    The session's state store must be RocksDB, which spills; ``start_sessions`` sees to that.
    """
    fields = CAPTURE_FIELDS
    processor = Sessions(fields, int(idle_seconds * 1000), FINAL_EVENTS)
    return captures.select(*fields).groupBy("session_id").transformWithState(processor, f"{CAPTURE_SCHEMA}, finished string", "append", "processingTime")


def start_sessions(captures: DataFrame, finished_path: str, checkpoint: str, idle_seconds: float = 24 * 3600, interval: str | None = None) -> StreamingQuery:
    """Write the captures of sessions as they finish: once over what is there, or at an interval.

    A stopped stream goes on from its checkpoint with the sessions that were open; the file sink takes each batch once.
    """
    writer = sessions(captures, idle_seconds).writeStream.format("parquet").option("path", finished_path).option("checkpointLocation", checkpoint)
    # Timers make batches without data at every moment, so a run over what is there would never end: its timers go off in batches with data.
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    own |= {} if interval else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = captures.sparkSession.conf
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:  # the query keeps the settings that it starts with
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts of ops in windows of ingestion time; only that axis can have a watermark."""
    return events.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", width), "op").agg(F.count("*").alias("n"))
