"""Periodic lifecycle job: reschedule stale queued articles every hour.

A ``rate`` source is used only as a clock: each trigger commits the delta of
``reschedule`` (``now`` = the trigger's processing time) to the article table,
which other jobs (``streaming.refresh``) commit to as well. A replayed trigger finds
nothing stale any more. ``streaming.claims`` does the same from a stream of
claims, with a timer per article and no scan of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import reschedule_delta
from ..sources.deltas import ArticleTable


def start_reschedule_stream(spark: SparkSession, articles_root: str, checkpoint: str,
                            period: str = "3600 seconds", once: bool = False) -> StreamingQuery:
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    table = ArticleTable(spark, articles_root)

    def run_batch(_: DataFrame, epoch: int) -> None:
        if table.version():
            table.commit(lambda articles: reschedule_delta(articles, F.current_timestamp()))

    w = clock.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(once=True) if once else w.trigger(processingTime=period)
    return w.start()
