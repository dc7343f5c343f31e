"""Stale claims by timers: keyed state per claimed article instead of scans of the table.

A stream of lifecycle events (uri, kind, at, retries) is grouped by article. A
``claim`` is kept in state with a timer of one hour; ``done`` ends it. When the timer
goes off, the article goes back to the queue (status N, one more retry), or to E with
the third, and its state is gone, so state holds the open claims alone. Time is
event time (``at``, under a watermark; deterministic) or processing time (the
service's clock).

The outcomes are committed to the article table as a delta under the
transaction (job, batch id): a batch that is replayed commits nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import MAX_RETRIES, STALE_AFTER_HOURS, STATUS_ERROR, STATUS_NEW
from ..sources.deltas import ArticleTable

EVENTS = "uri string, kind string, at timestamp, retries int"
OUTCOMES = "uri string, status string, retries int, update_time timestamp"
CLAIM, DONE = "claim", "done"
JOB = "claims"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClaimTimers(StatefulProcessor):
    """State of one article: the open claim's time (ms) and retries."""

    def __init__(self, event_time: bool, stale_ms: int, max_retries: int):
        self.event_time, self.stale_ms, self.max_retries = event_time, stale_ms, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "at long, retries int")

    def _end(self) -> None:
        self.claim.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _requeued(self, uri: str, retries: int, due: int) -> dict:
        status = STATUS_NEW if retries + 1 < self.max_retries else STATUS_ERROR
        return {"uri": uri, "status": status, "retries": retries + 1, "update_time": pd.Timestamp(due, unit="ms")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        events = [(pd.Timestamp(at).value // 1_000_000, kind, retries) for pdf in rows
                  for at, kind, retries in zip(pdf["at"], pdf["kind"], pdf["retries"]) if kind in (CLAIM, DONE) and not pd.isna(at)]
        out = []
        for at, kind, retries in sorted(events, key=lambda e: (e[0], e[1] != DONE)):
            start = at if self.event_time else now
            if self.claim.exists():
                since, tries = self.claim.get()
                # the timer was due before this event, though both are seen only now
                if start > since + self.stale_ms:
                    out.append(self._requeued(key[0], tries, since + self.stale_ms + 1))
                    self._end()
            if kind == DONE:
                self._end()
            else:
                self._end()
                self.claim.update((start, 0 if pd.isna(retries) else int(retries)))
                self.handle.registerTimer(start + self.stale_ms + 1)  # more than an hour, not exactly one
        yield pd.DataFrame(out, columns=["uri", "status", "retries", "update_time"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.claim.exists():
            since, tries = self.claim.get()
            if expiredTimerInfo.getExpiryTimeInMs() > since + self.stale_ms:
                out.append(self._requeued(key[0], tries, since + self.stale_ms + 1))
                self.claim.clear()
        yield pd.DataFrame(out, columns=["uri", "status", "retries", "update_time"])

    def close(self) -> None:
        pass


def requeued(events: DataFrame, event_time: bool = True, delay: str = "0 seconds", stale_hours: int = STALE_AFTER_HOURS,
             max_retries: int = MAX_RETRIES) -> DataFrame:
    """Stream (OUTCOMES) of the claims that went stale; ``events`` is a stream of EVENTS. Events without a uri have no article."""
    known = events.where("uri is not null")
    if event_time:
        known = known.withWatermark("at", delay)
    return known.groupBy("uri").transformWithStateInPandas(
        ClaimTimers(event_time, stale_hours * 3_600_000, max_retries), OUTCOMES, "Append", "EventTime" if event_time else "ProcessingTime")


def start_claim_stream(spark: SparkSession, events_dir: str, articles_root: str, checkpoint: str, event_time: bool = True,
                       delay: str = "0 seconds", available_now: bool = True, period: str = "60 seconds") -> StreamingQuery:
    """Requeues stale claims in the article table at ``articles_root`` from landing event files."""
    table = ArticleTable(spark, articles_root)
    stream = requeued(spark.readStream.schema(EVENTS).format("parquet").load(events_dir), event_time, delay)

    def run_batch(batch: DataFrame, epoch: int) -> None:
        table.commit(lambda _: batch.select("uri", "status", "retries", "update_time"), (JOB, epoch))

    w = stream.writeStream.outputMode("append").foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # timers need this store; the query keeps the setting it starts with
    try:
        return w.start()
    finally:
        spark.conf.set(_STORE, old)
